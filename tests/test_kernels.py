"""Bit strings, bases, containers and generators against slow plain-Python forms and golden values."""

import hashlib
import zlib

import numpy as np
import pytest

from relweave.functions import bits, codecs, gf2
from relweave.functions import container as C
from relweave.sources import generators as G

SEED = 20260829


def slow_bits(data):
    return [(b >> i) & 1 for b in data for i in range(8)]


def slow_decode(data):
    """A second decoder: one bit at a time, sharing nothing with the package."""
    stream, at = slow_bits(data), 0

    def number(n):
        nonlocal at
        out = sum(stream[at + i] << i for i in range(n))
        at += n
        return out

    def varint():
        code = shift = 0
        while True:
            b = number(8)
            code |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (code >> 1) ^ -(code & 1)

    assert bytes(number(8) for _ in range(4)) == b"DEDC" and number(8) == 1
    kind = number(8)
    if kind == 0:
        n, crc = number(64), number(32)
        out = bytes(number(8) for _ in range(n))
    elif kind == 1:
        rows, cols, n_piv, flags, size = number(32), number(32), number(32), number(8), number(64)
        left = [number(1) for _ in range(number(32))]
        pre = [number(1) for _ in range(number(32))] if flags & 4 else []
        mask = [number(1) for _ in range(cols)]
        free, piv = [c for c in range(cols) if not mask[c]], [c for c in range(cols) if mask[c]]
        wide = n_piv + (1 if flags & 2 else 0)
        coeff = [[number(1) for _ in range(wide)] for _ in free]
        cells = []
        for _ in range(rows):
            row = dict(zip(piv, [number(1) for _ in piv], strict=True))
            for f, c in zip(free, coeff, strict=True):
                v = c[n_piv] if flags & 2 else 0
                for p, k in zip(piv, c, strict=False):
                    v ^= k & row[p]
                row[f] = v
            cells += [row[c] for c in range(cols)]
        crc = number(32)
        whole = pre + cells + left
        out = bytes(sum(whole[8 * i + j] << j for j in range(8)) for i in range(len(whole) // 8))
        assert len(out) == size
    else:
        rows, cols, n_ind, n_rel = number(32), number(32), number(16), number(16)
        ind = [number(16) for _ in range(n_ind)]
        rel = []
        for _ in range(n_rel):
            z, x = number(16), number(16)
            y = number(16) if number(1) else None
            rel.append((z, x, y, varint(), varint(), varint()))
        number(64)
        table = []
        for _ in range(rows):
            row = {}
            for i in ind:
                v = number(64)
                row[i] = v - (1 << 64) if v >> 63 else v
            while len(row) < cols:
                for z, x, y, a, b, c in rel:
                    if x in row and (y is None or y in row):
                        row[z] = a * row[x] + (b * row[y] if y is not None else 0) + c
            table.append(b"".join((row[i]).to_bytes(8, "little", signed=True) for i in range(cols)))
        crc = number(32)
        out = b"".join(table)
    assert zlib.crc32(out) == crc and len(stream) - at < 8 and not any(stream[at:])
    return out


def test_bit_fields_read_back():
    rng = np.random.default_rng(SEED)
    for _ in range(200):
        fields = [(int(rng.integers(0, 1 << 62)) >> int(rng.integers(0, 62)), int(rng.integers(62, 70))) for _ in range(rng.integers(1, 12))]
        w = bits.BitWriter()
        for v, n in fields:
            w.number(v, n, "payload")
        data, account = w.finish()
        assert sum(account.values()) == 8 * len(data) and account["framing_bits"] < 8
        stream = slow_bits(data)
        r, at = bits.BitReader(data), 0
        for v, n in fields:
            assert r.number(n) == v == sum(stream[at + i] << i for i in range(n))
            at += n
    with pytest.raises(ValueError):
        bits.int_bits(256, 8)
    with pytest.raises(EOFError):
        bits.BitReader(b"a").bits(9)


def test_varints():
    for v in (0, 1, -1, 63, -64, 64, 2**63, -(2**63), 2**70):
        r = bits.BitReader(bits.varint_bytes(v))
        assert r.varint() == v and r.remaining == 0 and bits.unzigzag(bits.zigzag(v)) == v
    with pytest.raises(ValueError):
        bits.varint_bytes(2**80)


def test_known_ranks():
    assert gf2.column_basis(np.zeros((10, 5), dtype=np.uint8)).rank == 0
    assert gf2.column_basis(np.eye(7, dtype=np.uint8)).n_relations == 0
    rng = np.random.default_rng(SEED)
    for width in (1, 7, 8, 9, 64, 65, 130):
        m = rng.integers(0, 2, (200, width), dtype=np.uint8)
        for b in (gf2.column_basis(m), gf2.affine_column_basis(m)):
            assert gf2.holds(m, b) and b.rank + b.n_relations == width
    d = G.affine_parity_bits(400, 15, 3)
    m, _, _ = bits.reshape(d.data, 16)
    assert gf2.column_basis(m).n_relations == 0 and gf2.affine_column_basis(m).n_relations == 1


def test_leftmost_basis_by_brute_force():
    rng = np.random.default_rng(SEED)
    for _ in range(60):
        m = rng.integers(0, 2, (int(rng.integers(1, 12)), int(rng.integers(1, 10))), dtype=np.uint8)
        if rng.random() < 0.7 and m.shape[1] > 2:
            m[:, -1] = m[:, 0] ^ m[:, 1]
        spans, pivots = {bytes(len(m))}, []
        for c in range(m.shape[1]):
            col = m[:, c].tobytes()
            if col not in spans:
                pivots.append(c)
                spans |= {bytes(a ^ b for a, b in zip(s, col, strict=True)) for s in spans}
        assert gf2.column_basis(m).pivots == pivots


def test_states_merge_in_any_order():
    rng = np.random.default_rng(SEED)
    for _ in range(60):
        width = int(rng.integers(2, 140))
        m = (rng.integers(0, 2, (80, 5)) @ rng.integers(0, 2, (5, width)) & 1).astype(np.uint8)
        rows = bits.pack_rows(gf2.with_ones(m))
        whole = gf2.Echelon(width + 1)
        whole.absorb(rows)
        merged = gf2.Echelon(width + 1)
        for part in np.array_split(rng.permutation(rows), int(rng.integers(1, 6)))[::-1]:
            s = gf2.Echelon(width + 1)
            s.absorb(part)
            merged.absorb(s.rows)
        assert merged.pivots == whole.pivots and (merged.rows == whole.rows).all()
        linear, direct = gf2.basis_of(whole.without_first(), 80, False), gf2.column_basis(m)
        assert linear.pivots == direct.pivots and (linear.coefficients == direct.coefficients).all()


@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)) * 3, G.gf2_linear_code(300, 10, 6, 4).data, b"\x5a" + G.gf2_linear_code(400, 12, 12, 5).data, G.crc_records(64, 2).data])
def test_containers_read_back_twice(data):
    for width, offset in ((8, 0), (9, 0), (16, 0), (17, 3), (24, 8), (48, 31), (64, 0), (256, 1)):
        for affine in (False, True):
            e = C.encode_gf2(data, width, affine, offset)
            assert len(e.data) <= len(data) + 18 and C.decode(e.data) == data
            assert sum(e.account.values()) == 8 * len(e.data) and 0 <= e.account["framing_bits"] <= 7
            if len(data) < 1500:
                assert slow_decode(e.data) == data


def test_golden_sizes():
    d = G.gf2_linear_code(1280, 32, 32, 902)
    assert hashlib.sha256(d.data).hexdigest() == "c78ca4eb1e539975d9aa8b76779a790da3ab91af027b14de14c2d22c1f4b97d6"
    best = C.encode_best(d.data)
    assert (best.kind, len(best.data), best.n_relations) == ("GF2", 5291, 32) and slow_decode(best.data) == d.data
    near = C.encode_best(G.near_relation_bits(4096, 16, 51).data)
    assert (near.kind, len(near.data)) == ("PASSTHROUGH", 8722)
    crc = G.crc_records(4096, 5)
    assert [C.encode_gf2(crc.data, 64, a).n_relations for a in (False, True)] == [31, 32]
    fd = G.exact_functional_table(8192, 21, "affine")
    assert hashlib.sha256(fd.data).hexdigest() == "4f6c208becf02ec8d4ea5c77a4c922362a5ed886b84b550d547b400518e30ec7"
    t = C.encode_table(bits.bytes_to_table(fd.data, 3), [0, 1], [{"z": 2, "x": 0, "y": 1, "a": 3, "b": 5, "c": 7}])
    assert (t.kind, len(t.data)) == ("TABULAR_AFFINE", 131116) and C.decode(t.data) == fd.data


def test_table_containers_read_back_twice():
    d = G.integer_linear_table(40, 31, 1)
    e = C.encode_table(bits.bytes_to_table(d.data, 4), [0, 1, 3], [{"z": 2, "x": 0, "y": 1, "a": 2, "b": 3, "c": 5}])
    assert e.kind == "TABULAR_AFFINE" and C.decode(e.data) == slow_decode(e.data) == d.data


def test_nulls_never_beat_passthrough():
    for d in (G.mixed_noise_bits(2048, 64, 1), G.shuffled_bits(G.gf2_linear_code(512, 16, 16, 3), 4), G.near_relation_bits(4096, 16, 5)):
        assert len(C.encode_best(d.data).data) == len(d.data) + 18


def test_sign_extension_is_a_relation_of_bits_not_of_numbers():
    d = G.mixed_noise_table(200, 4, 2)
    assert C.encode_gf2(d.data, 64).n_relations == 33
    assert C.encode_table(bits.bytes_to_table(d.data, 4), [0, 1, 2, 3], []).kind == "PASSTHROUGH"


def test_odd_period_is_found_at_its_width_only():
    d = G.odd_period_code(600)
    assert C.encode_best(d.data).kind == "PASSTHROUGH" and C.encode_gf2(d.data, 48).n_relations == 24


def test_corrupted_containers_are_rejected():
    e = bytearray(C.encode_gf2(G.gf2_linear_code(300, 16, 16, 4).data, 32).data)
    e[-20] ^= 4
    with pytest.raises(ValueError):
        C.decode(bytes(e))
    with pytest.raises(ValueError):
        C.decode(b"DEDX" + bytes(20))


def test_codecs():
    for name in codecs.CODECS:
        n, _, ok, notes = codecs.measure(name, b"abc" * 1000)
        assert ok == (n is not None)
        if ok:
            assert codecs.decompress(name, codecs.compress(name, b"abc" * 1000)) == b"abc" * 1000
        else:
            assert name == "brotli11" and notes
    with pytest.raises(KeyError):
        codecs.compress("none", b"")


@pytest.mark.parametrize("affine,offset", [(False, 0), (True, 3)])
def test_containers_are_built_and_read_in_pieces(affine, offset):
    import tracemalloc

    data = np.random.default_rng(8).integers(97, 123, 12_000_000, dtype=np.uint8).tobytes()
    tracemalloc.start()
    e = C.encode_gf2(data, 64, affine, offset)
    built = tracemalloc.get_traced_memory()[1]
    back = C.decode(e.data)
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert e.kind == "GF2" and back == data
    assert max(built, read) < 8 * len(data)
    assert C.decode(C.encode_passthrough(data[:999]).data) == data[:999]
