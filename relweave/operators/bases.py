"""Distributed GF(2) column bases.

Bytes are read as records of ``width`` bits from bit ``offset`` on. Every task folds its records into one echelon state a
configuration (at most width + 1 rows, whatever the data); states are merged in two further steps, the first spread over
about the square root of the tasks. Verification and reconstruction are parity expressions on 64-bit words, without Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.functions.bits import bits_from_bytes, pack_rows
from relweave.functions.container import configurations
from relweave.functions.gf2 import Basis, Echelon, basis_of, with_ones

#: Bytes of a chunk that a task holds at once, and of the chunk after it that a record may reach into.
CHUNK_BYTES = 1 << 20
OVERLAP = 64

_STATE = "dataset_id string, width int, offset int, n_rows long, rows array<array<bigint>>"
_BASIS = "dataset_id string, width int, offset int, affine boolean, n_rows long, rank int, n_relations int, coeff_width int, pivots array<int>, free array<int>, masks array<array<bigint>>, const array<boolean>"


def xor_rows(rows: DataFrame, by: list[str], n_words: int) -> DataFrame:
    """The sum over GF(2) of each group's records (column ``words`` of ``n_words`` 64-bit words): one aggregate, combined before its shuffle."""
    return rows.groupBy(*by).agg(F.array(*[F.bit_xor(F.get("words", i)) for i in range(n_words)]).alias("words"), F.count("*").alias("n_rows"))


def chunked(datasets: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(dataset_id, bytes) to (dataset_id, start, total, bytes): chunks of ``size`` bytes, each with OVERLAP bytes more."""
    n = F.octet_length("bytes").cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(size).cast("long"))
    rows = datasets.select("dataset_id", "bytes", n.alias("total"), F.explode(starts).alias("start"))
    return rows.select("dataset_id", "start", "total", F.lit(size).alias("size"), F.substring("bytes", (F.col("start") + 1).cast("int"), F.lit(size + OVERLAP)).alias("bytes"))


def _span(start: int, size: int, total: int, width: int, offset: int) -> tuple[int, int]:
    """The numbers of the records that begin inside a chunk and end inside the dataset."""
    n_rows = max(0, 8 * total - offset) // width
    first = max(0, -(-(8 * start - offset) // width))
    return first, max(first, min(n_rows, -(-(8 * (start + size) - offset) // width)))


def _records(data: bytes, start: int, size: int, total: int, width: int, offset: int) -> np.ndarray:
    """0/1 rows of the records of ``_span``."""
    first, last = _span(start, size, total, width, offset)
    if last <= first:
        return np.zeros((0, width), dtype=np.uint8)
    at = offset + first * width - 8 * start
    return bits_from_bytes(data)[at : at + (last - first) * width].reshape(last - first, width)


def _to_state(key, n_rows: int, state: Echelon) -> dict:
    return dict(zip(("dataset_id", "width", "offset"), key, strict=True)) | {"n_rows": n_rows, "rows": [r.astype(np.int64).tolist() for r in state.rows]}


def _frame(rows: list[dict], like: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in like.replace("array<array<bigint>>", "x").split(", ")])


def _absorb_states(batches):
    held: dict[tuple, tuple[int, Echelon]] = {}
    for batch in batches:
        for d, w, o, n, rows in zip(batch["dataset_id"], batch["width"], batch["offset"], batch["n_rows"], batch["rows"], strict=True):
            seen, state = held.get((d, w, o), (0, None))
            state = state or Echelon(int(w) + 1)
            if len(rows):
                state.absorb(np.array([list(r) for r in rows], dtype=np.int64).astype(np.uint64))
            held[d, w, o] = (seen + int(n), state)
    yield _frame([_to_state(k, n, s) for k, (n, s) in held.items()], _STATE)


def merge_states(states: DataFrame) -> DataFrame:
    """(dataset_id, width, offset, n_rows, rows) merged to one row a configuration."""
    tasks = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mid = max(1, int(tasks**0.5))
    spread = states.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(mid)))
    spread = spread.repartition("dataset_id", "width", "offset", "__salt").drop("__salt").mapInPandas(_absorb_states, _STATE)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(_absorb_states(iter([pdf])))

    return spread.groupBy("dataset_id", "width", "offset").applyInPandas(final, _STATE)


def partial_states(chunks: DataFrame, configs: list[tuple[int, int, bool]]) -> DataFrame:
    """One state of [1 | A] for each task, dataset and (width, offset)."""
    pairs = sorted({(w, o) for w, o, _ in configs})

    def run(batches):
        held: dict[tuple, tuple[int, Echelon]] = {}
        for batch in batches:
            for d, start, total, size, data in zip(batch["dataset_id"], batch["start"], batch["total"], batch["size"], batch["bytes"], strict=True):
                for w, o in pairs:
                    n, state = held.get((d, w, o), (0, None))
                    state = state or Echelon(w + 1)
                    first, last = _span(int(start), int(size), int(total), w, o)
                    if len(state.pivots) <= w:  # to a full state no record can add a row
                        matrix = _records(data, int(start), int(size), int(total), w, o)
                        for lo in range(0, len(matrix), 1 << 16):
                            state.absorb(pack_rows(with_ones(matrix[lo : lo + (1 << 16)])))
                    held[d, w, o] = (n + last - first, state)
        yield _frame([_to_state(k, n, s) for k, (n, s) in held.items()], _STATE)

    return chunks.mapInPandas(run, _STATE)


def _signed(words: np.ndarray) -> list[int]:
    return words.astype(np.int64).tolist()


def _basis_rows(dataset_id, width: int, offset: int, n_rows: int, state: Echelon) -> list[dict]:
    out = []
    for affine in (False, True):
        b = basis_of(state, n_rows, True) if affine else basis_of(state.without_first(), n_rows, False)
        if not n_rows:  # no record: no relation
            b = Basis(0, width, list(range(width)), [], np.zeros((0, width), dtype=np.uint8), np.zeros(0, dtype=np.uint8), affine)
        out.append({
            "dataset_id": dataset_id, "width": width, "offset": offset, "affine": affine, "n_rows": n_rows, "rank": b.rank, "n_relations": b.n_relations, "coeff_width": b.coeff_width,
            "pivots": b.pivots, "free": b.free, "masks": [_signed(m) for m in b.masks()], "const": [bool(c) for c in b.const],
        })
    return out


def bases(datasets: DataFrame, configs: list[tuple[int, int, bool]] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A linear and an affine basis for each dataset (dataset_id, bytes), width and offset."""
    return merge_states_to_bases(partial_states(chunked(datasets, chunk_bytes), configs or configurations()))


def column_basis(rows: DataFrame, width: int, words: str = "words") -> DataFrame:
    """The linear and affine basis of records given as arrays of 64-bit words; equal narrow records are folded first."""
    rows = rows.select(F.col(words).alias("words"))
    if width <= 16:
        rows = rows.groupBy("words").agg(F.count("*").alias("n"))
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))

    def run(batches):
        state, n = Echelon(width + 1), 0
        for batch in batches:
            if len(batch):
                w = np.array([list(x) for x in batch["words"]], dtype=np.int64).astype(np.uint64)
                bits = np.unpackbits(np.ascontiguousarray(w).view(np.uint8).reshape(len(w), -1), axis=1, bitorder="little")[:, :width]
                state.absorb(pack_rows(with_ones(bits)))
                n += int(batch["n"].sum())
        yield _frame([_to_state(("rows", width, 0), n, state)], _STATE)

    return merge_states_to_bases(rows.mapInPandas(run, _STATE))


def merge_states_to_bases(states: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for d, w, o, n, got in zip(batch["dataset_id"], batch["width"], batch["offset"], batch["n_rows"], batch["rows"], strict=True):
                state = Echelon(int(w) + 1)
                if len(got):
                    state.absorb(np.array([list(r) for r in got], dtype=np.int64).astype(np.uint64))
                rows += _basis_rows(d, int(w), int(o), int(n), state)
            yield _frame(rows, _BASIS)

    return merge_states(states).mapInPandas(run, _BASIS)


# parity expressions on words


def bit(words: Column, j: int) -> Column:
    return F.getbit(F.get(words, j >> 6), F.lit(j & 63)).cast("int")


def parity(words: Column, mask: list[int]) -> Column:
    """0 or 1: the sum over GF(2) of the bits that ``mask`` (64-bit words) selects."""
    total = F.lit(0)
    for i, m in enumerate(mask):
        if m:
            total = total + F.bit_count(F.get(words, i).bitwiseAND(F.lit(m).cast("long")))
    return total % 2


def relation_holds(words: Column, mask: list[int], const: bool = False) -> Column:
    return parity(words, mask) == int(const)


def violations(rows: DataFrame, masks: list[tuple[list[int], bool]], words: str = "words") -> DataFrame:
    """(relation, n_violations) of each mask over all rows, in one pass."""
    w = F.col(words)
    counts = rows.agg(*[F.count_if(~relation_holds(w, m, c)).alias(f"r{i}") for i, (m, c) in enumerate(masks)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("relation"), F.col(f"r{i}").alias("n_violations")) for i in range(len(masks))])).alias("x")).select("x.*")


def rebuilt(words: Column, pivots: list[int], free: list[int], masks: list[list[int]], const: list[bool], width: int) -> Column:
    """The record rebuilt from its pivot bits alone, as an array of words."""
    out = []
    for i in range(-(-width // 64)):
        keep = sum(1 << (p & 63) for p in pivots if p >> 6 == i)
        word = F.get(words, i).bitwiseAND(F.lit(_int64(keep)).cast("long"))
        for f, m, c in zip(free, masks, const, strict=True):
            if f >> 6 == i:
                own = [x & ~(1 << (f & 63)) if k == f >> 6 else x for k, x in enumerate(m)]
                value = (parity(words, [_int64(x & (1 << 64) - 1) for x in own]) + int(c)) % 2
                word = word.bitwiseOR(F.shiftleft(value.cast("long"), f & 63))
        out.append(word)
    return F.array(*out)


def _int64(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def edges(found: DataFrame) -> DataFrame:
    """Bases as a table of (dataset_id, width, offset, affine, free_col, pivot_col): one row for each coefficient that is 1."""
    one = found.select("dataset_id", "width", "offset", "affine", "pivots", F.explode(F.arrays_zip("free", "masks")).alias("r"))
    cols = F.filter("pivots", lambda p: F.getbit(F.get(F.col("r.masks"), F.shiftright(p, 6)), p.bitwiseAND(63)) == 1)
    return one.select("dataset_id", "width", "offset", "affine", F.col("r.free").alias("free_col"), F.explode(cols).alias("pivot_col"))
