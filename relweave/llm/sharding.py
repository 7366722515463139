"""Sharding by histogram sort.

Rows are ordered by a 62-bit hash of their text, then by key, so equal texts are neighbours. The splitters that cut the
order into shards of equal bytes are found by probing: every round counts the exact bytes below evenly spaced candidate
keys inside the interval of each open splitter, over all partitions, and narrows the interval to the two probes around
its target, until a probe is within ``tolerance`` of the target or no key lies between the probes. Then the rows are
exchanged once, range-partitioned, and numbered within their shard.

The law is ``bytes``: shards' sizes are near equal, as far as equal texts, which are never parted, allow.

Defined results: a null text has size 1 and checksum 0 and is equal to other null texts, an empty text is a text of its
own; repeated rows go to one shard with different slots; an empty table gives an empty table; ``keep`` carries further
columns along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relweave.runtime import materialize, shuffle_partitions

BITS = 62
#: log2 of the probes a splitter and round.
PROBE_BITS = 8
TOLERANCE = 1e-4


def find_splitters(rows: DataFrame, shards: int, tolerance: float, key: str = "__group", size: str = "size") -> list[int]:
    """Splitters s_1 <= ... of ``shards`` - 1: shard j holds the keys in [s_j, s_(j+1)). Counts only travel to the driver: at most (shards - 1) * 2^PROBE_BITS a round."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    allowed = tolerance * total / shards
    targets = [total * j / shards for j in range(1, shards)]
    span = 1 << BITS
    # of each splitter: the interval's keys (low, high) and the exact bytes below each
    low, below_low = [0] * len(targets), [0] * len(targets)
    high, below_high = [span] * len(targets), [total] * len(targets)
    while True:
        open_ = sorted({(low[i], high[i]) for i, t in enumerate(targets) if high[i] - low[i] > 1 and min(t - below_low[i], below_high[i] - t) > allowed})
        if not open_:
            break
        counted: dict[int, dict[int, int]] = {}
        cell = None
        for n, (a, b) in enumerate(open_):
            shift = max(0, (b - a - 1).bit_length() - PROBE_BITS)
            hit = F.when((F.col(key) >= a) & (F.col(key) < b), F.struct(F.lit(n).alias("n"), F.shiftright(F.col(key) - F.lit(a), shift).alias("cell")))
            cell = hit if cell is None else F.coalesce(cell, hit)
        got = rows.select(cell.alias("c"), size).where("c is not null").groupBy("c").agg(F.sum(size).alias("b")).collect()
        for r in got:
            counted.setdefault(r["c"]["n"], {})[r["c"]["cell"]] = r["b"]
        place = {x: n for n, x in enumerate(open_)}
        for i, t in enumerate(targets):
            a, b = low[i], high[i]
            n = place.get((a, b))
            if n is None:
                continue
            shift, below = max(0, (b - a - 1).bit_length() - PROBE_BITS), below_low[i]
            for c, size_of in sorted(counted.get(n, {}).items()):
                start, end = a + (c << shift), min(b, a + ((c + 1) << shift))
                if below + size_of >= t:
                    low[i], below_low[i], high[i], below_high[i] = start, below, end, below + size_of
                    break
                below += size_of
    return [lo if t - bl <= bh - t else hi for lo, bl, hi, bh, t in zip(low, below_low, high, below_high, targets, strict=True)]


def shard_by_bytes(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, keep: list[str] | None = None) -> DataFrame:
    """``key`` (and ``keep``), size, text_crc32, law, shard, slot and grown_shard of each row."""
    extra = [c for c in (keep or []) if c != key]
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    group = F.shiftrightunsigned(F.xxhash64(F.col(text).isNull(), F.col(text)), 64 - BITS)
    rows = materialize(df.select(key, *extra, size.alias("size"), crc.cast("long").alias("text_crc32"), group.alias("__group")), "shard")
    cut = find_splitters(rows, shards, tolerance)
    shard = F.lit(0)
    for s in cut:
        shard = shard + F.when(F.col("__group") >= s, 1).otherwise(0)
    # the one exchange: ranges of (group, key); a row's number within its range is fixed by writing it down
    ranged = rows.withColumn("shard", shard.cast("int")).repartitionByRange(shuffle_partitions(df.sparkSession), "__group", key)
    ranged = ranged.sortWithinPartitions("__group", key)
    ranged = materialize(ranged.withColumn("__n", F.monotonically_increasing_id()), "shard")
    ranged = ranged.withColumn("__range", F.shiftright("__n", 33).cast("int"))
    # rows and first number of each part of a shard in a range: at most ranges + shards rows
    part = ranged.groupBy("shard", "__range").agg(F.count("*").alias("__rows"), F.min("__n").alias("__first"))
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("shard", "__range", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    out = ranged.join(F.broadcast(part), ["shard", "__range"])
    slot = (F.col("__n") - F.col("__first") + F.col("__before")).cast("long")
    return out.select(key, *extra, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
