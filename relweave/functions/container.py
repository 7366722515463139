"""The container's three kinds: byte layouts, encoders and one decoder.

All fields are least significant bit first in one bit stream, with up to 7 bits of framing at the end. Fixed values:
the magic ``DEDC``, version 1, kinds 0 passthrough, 1 GF(2), 2 tabular affine; GF(2) flags 1 affine, 2 ones pivot,
4 prefix.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

from relweave.functions.bits import BitReader, BitWriter, bits_from_bytes, bytes_to_table, row_pieces, table_to_bytes
from relweave.functions.bits import PIECE_BYTES, pack_rows
from relweave.functions.gf2 import Basis, Echelon, basis_of, holds, with_ones

MAGIC, VERSION = b"DEDC", 1
PASSTHROUGH, GF2, TABULAR_AFFINE = 0, 1, 2
KIND_NAMES = {PASSTHROUGH: "PASSTHROUGH", GF2: "GF2", TABULAR_AFFINE: "TABULAR_AFFINE"}
AFFINE, ONES_PIVOT, PREFIX = 1, 2, 4
#: Bytes that a passthrough container has besides its payload.
OVERHEAD = 18
WIDTHS = (8, 16, 32, 64, 128, 256)


@dataclass(frozen=True)
class Encoded:
    data: bytes
    account: dict[str, int]
    kind: str
    n_relations: int = 0
    n_independent: int = 0
    recovered_bits: int = 0
    config: dict = field(default_factory=dict)


def _preamble(kind: int) -> BitWriter:
    w = BitWriter()
    w.raw(MAGIC + bytes([VERSION, kind]), "header")
    return w


def passthrough_size(n_bytes: int) -> int:
    return n_bytes + OVERHEAD


def encode_passthrough(data: bytes) -> Encoded:
    w = _preamble(PASSTHROUGH)
    w.number(len(data), 64, "header")
    w.number(zlib.crc32(data), 32, "crc")
    w.raw(data, "payload")
    return Encoded(*w.finish(), "PASSTHROUGH")


def never_worse(candidate: Encoded, data: bytes) -> Encoded:
    return candidate if len(candidate.data) < passthrough_size(len(data)) else encode_passthrough(data)


def gf2_size_bits(n_rows: int, n_cols: int, n_pivots: int, coeff_width: int, leftover: int, prefix: int | None) -> int:
    """Bits of a GF(2) container before framing; ``prefix`` None: no prefix field."""
    return 216 + 32 + leftover + (0 if prefix is None else 32 + prefix) + n_cols + (n_cols - n_pivots) * coeff_width + n_rows * n_pivots + 32


def encode_gf2(data: bytes, width: int, affine: bool = False, offset: int = 0, basis: Basis | None = None) -> Encoded:
    """One configuration; a passthrough container where it has no relation or is not strictly smaller."""
    if width < 1 or not 0 <= offset < width:
        raise ValueError("the width must be positive and the offset below it")
    n_rows = max(0, 8 * len(data) - offset) // width
    if not n_rows:
        return encode_passthrough(data)
    if basis is None:
        state = Echelon(width + affine)
        for matrix in row_pieces(data, width, offset):
            state.absorb(pack_rows(with_ones(matrix) if affine else matrix))
        basis = basis_of(state, n_rows, affine)
    elif basis.affine != affine or not all(holds(matrix, basis) for matrix in row_pieces(data, width, offset)):
        raise ValueError("the given basis does not hold on the data")
    if not basis.free:
        return encode_passthrough(data)
    end = offset + n_rows * width
    prefix, leftover = bits_from_bytes(data[: -(-offset // 8)])[:offset], bits_from_bytes(data[end // 8 :])[end % 8 :]
    w = _preamble(GF2)
    for value in (n_rows, width, len(basis.pivots)):
        w.number(value, 32, "header")
    w.number((AFFINE | ONES_PIVOT if affine else 0) | (PREFIX if offset else 0), 8, "header")
    w.number(len(data), 64, "header")
    w.number(len(leftover), 32, "leftover")
    w.bits(leftover, "leftover")
    if offset:
        w.number(offset, 32, "prefix")
        w.bits(prefix, "prefix")
    mask = np.zeros(width, dtype=np.uint8)
    mask[basis.pivots] = 1
    w.bits(mask, "relation")
    # the constant's coefficient comes last
    w.bits(np.concatenate([basis.coefficients, basis.const[:, None]], axis=1) if affine else basis.coefficients, "relation")
    for matrix in row_pieces(data, width, offset):
        w.bits(matrix[:, basis.pivots], "payload")
    w.number(zlib.crc32(data), 32, "crc")
    made, account = w.finish()
    return never_worse(Encoded(made, account, "GF2", basis.n_relations, basis.rank, basis.recovered_bits, {"width": width, "offset": offset, "affine": affine}), data)


def encode_table(table: np.ndarray, independents: list[int], relations: list[dict]) -> Encoded:
    """An int64 table by its independent columns; relations: z, x, y (or None), a, b, c."""
    data = table_to_bytes(table)
    if not relations or not len(table):
        return encode_passthrough(data)
    w = _preamble(TABULAR_AFFINE)
    for value, width in ((len(table), 32), (table.shape[1], 32), (len(independents), 16), (len(relations), 16)):
        w.number(value, width, "header")
    for i in independents:
        w.number(i, 16, "relation")
    for r in relations:
        w.number(r["z"], 16, "relation"), w.number(r["x"], 16, "relation"), w.number(int(r["y"] is not None), 1, "relation")
        if r["y"] is not None:
            w.number(r["y"], 16, "relation")
        for c in "abc":
            w.varint(r[c], "relation")
    payload = table_to_bytes(table[:, independents])
    w.number(len(payload), 64, "header")
    w.raw(payload, "payload")
    w.number(zlib.crc32(data), 32, "crc")
    made, account = w.finish()
    return never_worse(Encoded(made, account, "TABULAR_AFFINE", len(relations), len(independents), 64 * len(table) * len(relations)), data)


def apply_relations(columns: dict[int, np.ndarray], relations: list[dict]) -> dict[int, np.ndarray]:
    """Fill in dependent columns in an order that their sources allow; exact integers."""
    todo = list(relations)
    while todo:
        ready = [r for r in todo if r["x"] in columns and (r["y"] is None or r["y"] in columns)]
        if not ready:
            raise ValueError("the relations are cyclic or lack a source")
        for r in ready:
            z = columns[r["x"]].astype(object) * r["a"] + r["c"]
            columns[r["z"]] = z if r["y"] is None else z + columns[r["y"]].astype(object) * r["b"]
        todo = [r for r in todo if r not in ready]
    return columns


def decode(container: bytes) -> bytes:
    """The bytes that a container of any kind stands for; raises if the checksum or a length differs."""
    r = BitReader(container)
    if r.raw(4) != MAGIC or r.number(8) != VERSION:
        raise ValueError("no container of a known version")
    kind = r.number(8)
    if kind == PASSTHROUGH:
        size, crc = r.number(64), r.number(32)
        data = r.raw(size)
    elif kind == GF2:
        n_rows, n_cols, n_pivots, flags, size = r.number(32), r.number(32), r.number(32), r.number(8), r.number(64)
        if flags & ~(AFFINE | ONES_PIVOT | PREFIX):
            raise ValueError("unknown flags")
        leftover = r.bits(r.number(32))
        prefix = r.bits(r.number(32)) if flags & PREFIX else np.zeros(0, dtype=np.uint8)
        mask = r.bits(n_cols)
        pivots, free = np.flatnonzero(mask).tolist(), np.flatnonzero(mask == 0).tolist()
        if len(pivots) != n_pivots:
            raise ValueError("the pivot mask does not match the number of pivots")
        wide = n_pivots + (1 if flags & ONES_PIVOT else 0)
        coeff = r.bits(len(free) * wide).reshape(len(free), wide)
        const = coeff[:, n_pivots] if flags & ONES_PIVOT else np.zeros(len(free), dtype=np.uint8)
        basis = Basis(n_rows, n_cols, pivots, free, coeff[:, :n_pivots], const, bool(flags & AFFINE))
        if n_rows * n_pivots > r.remaining:
            raise EOFError("the bit string ends early")
        back, step = BitWriter(), max(1, 8 * PIECE_BYTES // max(n_cols, 1))
        back.bits(prefix, "prefix")
        for lo in range(0, n_rows, step):
            m = min(step, n_rows - lo)
            back.bits(basis.rebuild(r.bits(m * n_pivots).reshape(m, n_pivots)), "payload")
        crc = r.number(32)
        back.bits(leftover, "leftover")
        data, account = back.finish()
        if len(data) != size or account["framing_bits"]:
            raise ValueError("the length differs")
    elif kind == TABULAR_AFFINE:
        n_rows, n_cols, n_ind, n_rel = r.number(32), r.number(32), r.number(16), r.number(16)
        independents = [r.number(16) for _ in range(n_ind)]
        relations = []
        for _ in range(n_rel):
            z, x = r.number(16), r.number(16)
            y = r.number(16) if r.number(1) else None
            relations.append({"z": z, "x": x, "y": y, "a": r.varint(), "b": r.varint(), "c": r.varint()})
        kept = bytes_to_table(r.raw(r.number(64)), max(1, n_ind))
        crc = r.number(32)
        columns = apply_relations({c: kept[:, i] for i, c in enumerate(independents)}, relations)
        data = table_to_bytes(np.column_stack([columns[c].astype(np.int64) for c in range(n_cols)]) if n_rows else np.zeros((0, n_cols)))
    else:
        raise ValueError(f"unknown kind {kind}")
    if zlib.crc32(data) != crc:
        raise ValueError("the checksum differs")
    if r.remaining >= 8:
        raise ValueError("bytes are left over")
    return data


def configurations(widths=WIDTHS, offsets: dict[int, list[int]] | None = None) -> list[tuple[int, int, bool]]:
    """(width, offset, affine) in the order that ties prefer."""
    return [(w, o, a) for w in widths for o in (offsets or {}).get(w, [0]) for a in (False, True)]


#: Bit phases searched by default: all of each width up to 64, eight of the wider ones.
ALL_OFFSETS = {w: list(range(w if w <= 64 else 8)) for w in WIDTHS}


def encode_best(data: bytes, configs: list[tuple[int, int, bool]] | None = None) -> Encoded:
    """The smallest container over the configurations; passthrough, then the earliest, wins ties. Plain single-process form."""
    best = encode_passthrough(data)
    for width, offset, affine in configs or configurations():
        made = encode_gf2(data, width, affine, offset)
        if len(made.data) < len(best.data):
            best = made
    return best
