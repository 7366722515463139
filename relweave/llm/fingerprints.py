"""One-permutation MinHash fingerprints with optimal densification and b-bit packing.

Each shingle is hashed once; its high bits choose a bin, a bin keeps its smallest hash. An empty bin probes a fixed
pseudo-random sequence of bins of its own until it meets a filled one and copies it (optimal densification). The low
``BITS`` bits of each bin are packed. Two fingerprints that agree in a share m of their bins have the likeness
(m - 2^-b) / (1 - 2^-b), cut to 0..1: chance agreement is taken out.

Defined results: null counts as an empty text; a text without words has the empty string as its fingerprint, alike
(1.0) only to another such; a text of fewer words than a shingle is one shingle; equal texts have equal fingerprints;
texts of any length count whole; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.shingles import chunks, mix, text_shingles
from relweave.runtime import shuffle_partitions

BINS = 512
BITS = 4
SHINGLE = 5


def signatures(texts: list[str | None], bins: int = BINS, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The densified bins (uint64) of each text, a row each, and whether it has any shingle."""
    log = int(bins).bit_length() - 1
    hashes, ends = text_shingles(texts, k)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))
    empty = np.uint64((1 << 64) - 1)
    low = hashes & np.uint64((1 << (64 - log)) - 1)
    out = np.full(len(texts) * bins, empty, dtype=np.uint64)
    np.minimum.at(out, doc * bins + (hashes >> np.uint64(64 - log)).astype(np.int64), low)
    some = np.zeros(len(texts), dtype=bool)
    some[doc] = True
    filled = out != empty
    active = np.flatnonzero(~filled & np.repeat(some, bins))
    attempt = 0
    while len(active):
        attempt += 1
        own = active % bins
        probe = (mix(own.astype(np.uint64) + np.uint64(attempt * bins)) & np.uint64(bins - 1)).astype(np.int64)
        donor = active - own + probe
        hit = filled[donor]
        out[active[hit]] = out[donor[hit]]
        active = active[~hit]
    return out.reshape(len(texts), bins), some


def pack(sig: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """The low bits of each row as hex; the empty string for a text without shingles."""
    low = (sig & np.uint64((1 << bits) - 1)).astype(np.uint8)
    planes = np.unpackbits(low[:, :, None], axis=2, bitorder="little", count=bits)
    packed = np.packbits(planes.reshape(len(sig), -1), axis=1, bitorder="little")
    return [row.tobytes().hex() if ok else "" for row, ok in zip(packed, some, strict=True)]


def fingerprints(texts: list[str | None], bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> list[str]:
    return [x for lo, hi in chunks(texts) for x in pack(*signatures(texts[lo:hi], bins, k), bits)]


def likeness(a: str, b: str, bits: int = BITS) -> float:
    """Bias-corrected share of agreeing bins of two fingerprints: an estimate of the Jaccard similarity."""
    if not a or not b:
        return float(a == b)
    x, y = (np.unpackbits(np.frombuffer(bytes.fromhex(s), dtype=np.uint8), bitorder="little").reshape(-1, bits) for s in (a, b))
    chance = 2.0**-bits
    return float(np.clip(((x == y).all(axis=1).mean() - chance) / (1 - chance), 0.0, 1.0))


def fingerprint_documents(df: DataFrame, text: str = "text", out: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the fingerprint of each whole text; replaces a column of that name."""
    kept = [c for c in (keep or df.columns) if c != out]

    def run(batches):
        for batch in batches:
            yield batch.drop(columns="__text").assign(**{out: fingerprints(batch["__text"].tolist())})

    return df.select(*kept, F.col(text).alias("__text")).mapInPandas(run, df.select(*kept).schema.add(out, "string"))


def with_successor(df: DataFrame, key: str, text: str, run, schema) -> DataFrame:
    """Apply ``run(rows, next_row)`` over rows in descending ``key`` order; the row after the last is the first.

    ``key`` ranges of about equal row counts go to tasks (splitters: approximate quantiles, one number a task). The
    first row of each range goes to the range before it as well, so each task knows its last row's successor.
    Nulls in ``key`` come last; rows with equal keys are ordered by text.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    n = shuffle_partitions(spark)
    cut = sorted(set(rows.approxQuantile("__key", [i / n for i in range(1, n)], 1 / (8 * n))), reverse=True) if n > 1 else []
    cut = [int(c) for c in cut]
    # two levels of splitters, so that a row is compared with about 2 sqrt(n) of them
    step = max(1, int(len(cut) ** 0.5))
    group = [cut[i : i + step] for i in range(0, len(cut), step)]
    above = lambda many, x: F.size(F.filter(many, lambda s: s > x))
    if cut:
        coarse = F.array(*[F.lit(g[-1]).cast("long") for g in group])
        fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in group])
        full = above(coarse, F.col("__key"))
        rest = F.coalesce(above(F.get(fine, full), F.col("__key")), F.lit(0))
        at = F.coalesce(F.when(rest < 0, 0).otherwise(rest) + full * step, F.lit(len(cut)))
        at = F.when(F.col("__key").isNull(), len(cut)).otherwise(F.least(at, F.lit(len(cut))))
    else:
        at = F.lit(0)
    rows = rows.withColumn("__at", at.cast("int"))
    first = rows.groupBy("__at").agg(F.max("__key").alias("top"), F.count("*").alias("n")).collect()  # a row a range
    first = sorted((r["__at"], r["top"]) for r in first)
    # null keys have no maximum: a range of nulls only is possible for the last range alone
    edges = {a: (top, first[i - 1][0]) for i, (a, top) in enumerate(first)}
    many = max(n, len(cut) + 1)
    if edges:
        tops = F.array(*[F.lit(edges.get(i, (None, 0))[0]).cast("long") for i in range(len(cut) + 1)])
        before = F.array(*[F.lit(edges.get(i, (None, 0))[1]).cast("int") for i in range(len(cut) + 1)])
        is_edge = F.get(tops, F.col("__at")).eqNullSafe(F.col("__key"))
        own = F.struct(F.col("__at").alias("at"), F.lit(False).alias("edge"))
        also = F.struct(F.get(before, F.col("__at")).alias("at"), F.lit(True).alias("edge"))
        rows = rows.withColumn("__to", F.explode(F.when(is_edge, F.array(own, also)).otherwise(F.array(own))))
    else:
        rows = rows.withColumn("__to", F.struct(F.col("__at").alias("at"), F.lit(False).alias("edge")))
    rows = rows.select("__key", F.col("__key").cast("string").alias("__id"), "__text", F.col("__to.at").alias("__at"), F.col("__to.edge").alias("__edge"))
    dealt = rows.repartitionById(many, F.col("__at")) if hasattr(rows, "repartitionById") else rows.repartition(many, "__at")
    dealt = dealt.sortWithinPartitions("__at", "__edge", F.desc_nulls_last("__key"), F.asc_nulls_first("__text"))

    def each(batches):
        held = None  # the last row of the batch before, whose successor is not known yet
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            held = batch.iloc[-1:]
            yield from _settled(batch, run)
        # the last row of a task is always an edge row, which is only a successor

    return dealt.mapInPandas(each, schema)


def _settled(batch: pd.DataFrame, run):
    """Results of all rows but the last, except edge rows."""
    texts, keys = batch["__text"].tolist(), [None if k is None else int(k) for k in batch["__id"].tolist()]
    edge, at = batch["__edge"].to_numpy(dtype=bool), batch["__at"].to_numpy()
    n = len(texts) - 1
    for lo, hi in chunks(texts[:n], 1_000_000):
        own = [i for i in range(lo, hi) if not edge[i]]
        if own:
            assert all(at[i] == at[i + 1] for i in own)
            yield run([keys[i] for i in own], texts[lo : hi + 1], [i - lo for i in own])


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Edited: the last floor(n/3) code points replaced by the first as many (or all) of the successor in descending key
    order (of the last: the first). Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.
    """

    def run(keys, texts, own):
        texts = [t or "" for t in texts]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][: len(texts[i]) // 3] for i in own]
        print_of = fingerprints(texts)
        of_edited = fingerprints(edited)
        return pd.DataFrame(
            {
                key: pd.array(keys, dtype="Int64"),
                "n_chars": np.array([len(texts[i]) for i in own], dtype=np.int64),
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": [print_of[i] for i in own],
                "edited_fingerprint": of_edited,
                "near_edited": [likeness(print_of[i], e) for i, e in zip(own, of_edited, strict=True)],
                "near_next": [likeness(print_of[i], print_of[i + 1]) for i in own],
            }
        )

    schema = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successor(df, key, text, run, schema)
