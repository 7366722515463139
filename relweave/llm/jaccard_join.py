"""N-gram Jaccard join with multiple-global-order filtering.

Texts with equal word sequences form a class; classes are joined. Under any one order of all shingles, two sets whose
similarity reaches the threshold share a shingle among their first n - ceil(t n) + 1. The first order is by rarity (a
count sketch of all shingles, ties by hash), so common shingles come last; two more orders are by independent hashes.
A pair is made only if it shares a prefix shingle of the first order, its sizes and the places of that shingle allow the
threshold, and so do the bitmaps of both sets (a shingle flips one of ``PARITY`` bits, so at most as many bits differ as
shingles do). Under each other order both prefixes are then compared up to the lower of their ends, below which both are
complete: what is missing on either side there bounds the intersection from above. Only pairs that every order lets
through are verified, on whole shingle sets; until then prefixes of 16-bit hashes travel, not texts.

Large groups of copies. Verified pairs only matter as far as they connect classes, so a prefix shingle's classes are
first compared with one of them each (the leader), in a few turns with other leaders; where that has put all classes of
a shingle into one component, no further pair of it can change anything. Of the other shingles, every pair across
components is compared: all at once if they are few, else a bounded number for each class at a time, and those that lie
in one component by then are left out. This loses no link: the components are those of all links.

Defined results: words are lower-cased (A-Z) and parted by ASCII white space; a text with fewer words than a shingle has
one, its whole sequence; null, empty and blank texts have none and link with nothing; a null key has a null component
and links with nothing; rows that repeat a key are compared each, and what any of them links with is in one component;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relweave.llm.components import connected_components
from relweave.llm.shingles import chunks, distinct_sorted, mix, sequence_hashes, shingle_hashes, text_shingles, word_hashes
from relweave.runtime import materialize, release

#: log2 of the counters of the rarity sketch; the driver holds one number for each.
SKETCH_BITS = 17
LEADERS = 4
#: Turns of comparing with leaders before the remaining pairs across components are compared.
TURNS = 2
#: Pairs across components up to which all are compared at once; of more, each class has PAIRS_EACH at a time, then four times as many.
FEW_PAIRS, PAIRS_EACH = 20_000, 8
#: Bits of a set's bitmap.
PARITY = 256
#: Keys up to which a set of them (tens of bytes each) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
_ORDERS = (0x9FB21C651E98DF25, 0x2545F4914F6CDD1D)


def _profile(batches, k: int):
    """Per text: key, n, the class hashes; at the end of a task: its shingle counts by bucket (as rows without class)."""
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for batch in batches:
        texts, keys = batch["__text"].tolist(), batch["__key"]
        for lo, hi in chunks(texts):
            words, ends = word_hashes(texts[lo:hi])
            c1, c2 = sequence_hashes(words, ends)
            hashes, n = _distinct(*shingle_hashes(words, ends, k))
            sketch += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            yield pd.DataFrame({"d": keys.iloc[lo:hi].to_numpy(), "n": n, "c1": c1.astype(np.int64), "c2": c2.astype(np.int64), "bucket": pd.array([None] * (hi - lo), dtype="Int32")})
    some = np.flatnonzero(sketch)
    yield pd.DataFrame({"d": pd.array([None] * len(some), dtype="string"), "n": sketch[some], "c1": 0, "c2": 0, "bucket": pd.array(some.astype(np.int32), dtype="Int32")})


def _distinct(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' hashes, once for each text, and their number by text (at most 4096 texts)."""
    doc = np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(np.r_[0, ends]))
    key = doc << np.uint64(52) | hashes >> np.uint64(12)
    order = np.argsort(key)
    key = key[order]
    keep = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, dtype=bool)
    return hashes[order][keep], np.bincount((key[keep] >> np.uint64(52)).astype(np.int64), minlength=len(ends))


def rarity_levels(counts: np.ndarray) -> np.ndarray:
    """0 for buckets as full as chance makes them, else 1 + log2 of the surplus: the coarse part of the first order."""
    mean = counts.mean()
    surplus = counts - mean
    hot = surplus > 6 * np.sqrt(mean) + 64
    return np.where(hot, np.minimum(1 + np.log2(np.maximum(surplus, 1)).astype(np.int64), 31), 0).astype(np.uint64)


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles of a set's signature: the threshold's prefix, lengthened by two thirds so that its bound has force."""
    return np.minimum(n, (n - -(-n * num // den)) * 5 // 3 + 8)


def _bytes_each(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[bytes]:
    raw, width = flat.tobytes(), flat.itemsize
    return [raw[f : f + m] for f, m in zip((first * width).tolist(), (size * width).tolist(), strict=True)]


def _prefixes(batches, k: int, num: int, den: int, levels: np.ndarray):
    """Per text: n, the first n - ceil(t n) + 1 shingles under the first order, rarest first, as 52-bit tokens, the first
    shingles under each further order as sorted 16-bit numbers, and the bitmap."""
    for batch in batches:
        texts, keys = batch["__text"].tolist(), batch["__key"]
        for lo, hi in chunks(texts):
            m = hi - lo
            hashes, ends = text_shingles(texts[lo:hi], k)
            doc = np.repeat(np.arange(m, dtype=np.uint64), np.diff(np.r_[0, ends]))
            level = levels[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            key = np.sort(doc << np.uint64(52) | level << np.uint64(47) | mix(hashes) >> np.uint64(17))
            key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
            owner = key >> np.uint64(52)
            doc, token = owner.astype(np.int64), key & np.uint64((1 << 52) - 1)
            n = np.bincount(doc, minlength=m)
            first = np.cumsum(n) - n
            size = np.where(n > 0, n + 1 - -(-n * num // den), 0)
            take = np.arange(len(key)) - first[doc] < size[doc]
            out = {"d": keys.iloc[lo:hi].to_numpy(), "n": n.astype(np.int32), "tokens": np.split(token[take].astype(np.int64), np.cumsum(size)[:-1])}
            long = prefix_length(n, num, den)
            for i, salt in enumerate(_ORDERS):
                low = (np.sort(owner << np.uint64(16) | mix(token ^ np.uint64(salt)) >> np.uint64(48)) & np.uint64(0xFFFF)).astype("<u2")
                out[f"s{i}"] = _bytes_each(low, first, long)
            odd = np.bincount(doc * PARITY + (token & np.uint64(PARITY - 1)).astype(np.int64), minlength=m * PARITY) & 1
            bits = np.packbits(odd.astype(np.uint8).reshape(m, PARITY), axis=1).view("<i8")
            yield pd.DataFrame(out | {f"p{i}": bits[:, i] for i in range(PARITY // 64)})


def _common(x: np.ndarray, x_of: np.ndarray, y: np.ndarray, y_of: np.ndarray, pairs: int) -> np.ndarray:
    """For each pair the numbers that both its lists have; no list has one twice."""
    value, owner = np.r_[x, y], np.r_[x_of, y_of]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    return np.bincount(owner[1:][(value[1:] == value[:-1]) & (owner[1:] == owner[:-1])], minlength=pairs)


def _flat(prefixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All prefixes' numbers, the pair of each, and each prefix's length."""
    size = np.array([len(p) // 2 for p in prefixes], dtype=np.int64)
    return np.frombuffer(b"".join(prefixes), dtype="<u2"), np.repeat(np.arange(len(prefixes)), size), size


def may_reach(nx: np.ndarray, ny: np.ndarray, xs: list[bytes], ys: list[bytes], num: int, den: int) -> np.ndarray:
    """For each pair, False only if its two prefixes prove that the sets cannot reach the threshold."""
    m, sides = len(nx), []
    for n, prefixes in ((nx, xs), (ny, ys)):
        flat, of, size = _flat(prefixes)
        last = np.full(m, 1 << 16, dtype=np.int64)
        cut = (size < n) & (size > 0)
        last[cut] = flat[np.cumsum(size)[cut] - 1]
        sides.append((flat, of, np.where((size < n) & (size == 0), 0, last)))
    end = np.minimum(sides[0][2], sides[1][2])
    held, twice, rest = [], [], []
    for n, (flat, of, _) in zip((nx, ny), sides, strict=True):
        inside = flat < end[of]
        flat, of = flat[inside], of[inside]
        new = np.r_[True, (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])] if len(flat) else np.zeros(0, dtype=bool)
        held.append((flat[new], of[new]))
        twice.append(np.bincount(of[~new], minlength=m))
        rest.append(n - np.bincount(of, minlength=m))
    # a number that several shingles of a set share may stand for as many common ones: the bound only grows
    most = _common(*held[0], *held[1], m) + np.maximum(*twice) + np.minimum(*rest)
    return most * (den + num) >= num * (nx + ny)


def _pass(batches, num: int, den: int):
    """The pairs that every further order lets through."""
    for b in batches:
        nx, ny = b["n_a"].to_numpy().astype(np.int64), b["n_b"].to_numpy().astype(np.int64)
        good = np.ones(len(b), dtype=bool)
        for i in range(len(_ORDERS)):
            some = np.flatnonzero(good)
            good[some] = may_reach(nx[some], ny[some], b[f"s{i}_a"].iloc[some].tolist(), b[f"s{i}_b"].iloc[some].tolist(), num, den)
        yield b.loc[good, ["a", "b"]]


def _verify(batches, k: int, num: int, den: int):
    """The pairs whose whole sets reach the threshold."""
    for batch in batches:
        size = batch["text_a"].str.len().fillna(0) + batch["text_b"].str.len().fillna(0)
        for lo, hi in _parts(size.to_numpy()):
            part = batch.iloc[lo:hi]
            m = len(part)
            flat, ends = distinct_sorted(*text_shingles(part["text_a"].tolist() + part["text_b"].tolist(), k))
            n = np.diff(np.r_[0, ends])
            of, half = np.repeat(np.arange(2 * m), n), ends[m - 1]
            both = _common(flat[:half], of[:half], flat[half:], of[half:] - m, m)
            yield part.loc[(both > 0) & (both * den >= num * (n[:m] + n[m:] - both)), ["a", "b"]]


def _parts(size: np.ndarray, most: int = 2_000_000):
    """Ranges of rows of about ``most`` characters."""
    group = np.cumsum(size) // most
    edge = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(size)]
    return [(lo, hi) for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if lo < hi]


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The verified ones of the candidate pairs (a, b), after the further orders' filters."""
    orders = [f"s{i}" for i in range(len(_ORDERS))]
    a, b = (classes.select(F.col("d").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ["n", *orders]]) for e in "ab")
    pairs = materialize(pairs.join(a, "a").join(b, "b").mapInPandas(lambda it: _pass(it, num, den), pairs.select("a", "b").schema).distinct(), "nj")
    ids = materialize(pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d"))).distinct(), "nj")
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = materialize(docs.join(F.broadcast(ids) if few else ids, "d", "left_semi"), "nj")
    left = texts.select(F.col("d").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("d").alias("b"), F.col("text").alias("text_b"))
    whole = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    links = materialize(whole.mapInPandas(lambda it: _verify(it, k, num, den), pairs.select("a", "b").schema).distinct(), "nj")
    release(pairs), release(ids), release(texts)
    return links


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``key``, n_shingles and component_id of each row; linked: den * intersection >= num * union of k-word shingle sets."""
    docs = df.select(F.col(key).alias("d"), F.col(text).alias("text"))
    kind = docs.schema["d"].dataType.simpleString()
    given = docs.select(F.col("d").cast("string").alias("__key"), F.col("text").alias("__text"))
    seen = materialize(given.mapInPandas(lambda it: _profile(it, k), "d string, n long, c1 long, c2 long, bucket int"), "nj")
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    summed = seen.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n"))
    # one number a bucket, in a few long lists: a row each would take the driver much more memory
    for r in summed.groupBy(F.shiftright("bucket", 12)).agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).select("at", "n").collect():
        counts[r["at"]] = r["n"]
    levels = rarity_levels(counts)
    rows = seen.where("bucket is null").select(F.col("d").cast(kind).alias("d"), "n", "c1", "c2")
    classes = materialize(rows.where("n > 0 and d is not null").groupBy("c1", "c2").agg(F.min("d").alias("rep")), "nj")
    rep = classes.select(F.col("rep").alias("d")).distinct()

    # a row a class: its prefixes under all orders and its bitmap
    bitmap = [f"p{i}" for i in range(PARITY // 64)]
    shape = "d string, n int, tokens array<long>, " + ", ".join([*(f"s{i} binary" for i in range(len(_ORDERS))), *(f"{p} long" for p in bitmap)])
    first = given.where("__key is not null").mapInPandas(lambda it: _prefixes(it, k, num, den, levels), shape)
    first = materialize(first.withColumn("d", F.col("d").cast(kind)).where("n > 0").join(rep, "d", "left_semi"), "nj")

    # (token, d, place) of every prefix shingle that at least two of them have
    rows_of = first.select("d", F.posexplode("tokens").alias("place", "token"))
    hot = F.shiftright("token", 47) > 0
    rows_of = rows_of.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("d"), F.lit(1024))).otherwise(F.lit(0)).cast("int"))
    rows_of = rows_of.withColumn("same", F.count("*").over(Window.partitionBy("token", "salt"))).where((F.col("same") > 1) | hot)
    shared = materialize(rows_of.select("token", "d", "place"), "nj")

    def can_match(x: str, y: str) -> Column:
        """Whether the sizes, the places of the shingle and the bitmaps of two rows allow the threshold."""
        n, m = F.col(f"{x}n"), F.col(f"{y}n")
        fits = F.least(n, m) * den >= F.greatest(n, m) * num
        reach = F.least(n - F.col(f"{x}place"), m - F.col(f"{y}place")) * (den + num) >= num * (n + m)
        differ = sum((F.bit_count(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}"))) for p in bitmap), F.lit(0))
        return fits & reach & ((n + m - differ) * (den + num) >= 2 * num * (n + m))

    held = ["d", "n", "place", "c", *bitmap]

    def side(of: DataFrame, s: str) -> DataFrame:
        return of.select("token", *[F.col(c).alias(f"{s}{c}") for c in held])

    def against_leaders(members: DataFrame, turn: int) -> DataFrame:
        """Candidate pairs of each shingle's members with one of them; few different leaders, so that pairs recur and fall together."""
        order = F.xxhash64(F.lit(turn), F.pmod(F.col("token"), F.lit(LEADERS)), "d")
        lead = members.groupBy("token").agg(F.min_by("d", order).alias("lead"))
        lead = members.join(lead, "token").where("d = lead").drop("lead")
        return pairs_of(side(members, "x_").join(side(lead, "y_"), "token").where((F.col("x_c") != F.col("y_c")) & can_match("x_", "y_")))

    def pairs_of(met: DataFrame) -> DataFrame:
        return materialize(met.select(F.least("x_d", "y_d").alias("a"), F.greatest("x_d", "y_d").alias("b")).distinct(), "nj")

    def still_open(members: DataFrame, part: DataFrame | None) -> DataFrame:
        """The members of shingles whose classes lie in several components, with their components c."""
        own = F.col("d") if part is None else F.coalesce("component_id", "d")
        placed = members.select("token", "d", "place") if part is None else members.select("token", "d", "place").join(part.select(F.col("node").alias("d"), "component_id"), "d", "left")
        placed = placed.select("token", "d", "place", own.alias("c"))
        open_ = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("token")
        placed = placed.join(open_, "token", "left_semi").join(first.select("d", "n", *bitmap), "d")
        return materialize(placed.select("token", *held), "nj")

    rest = still_open(shared, None)
    release(shared)

    # rows of one key connect their classes
    own = rows.where("n > 0 and d is not null").join(classes, ["c1", "c2"]).select("d", "rep").groupBy("d").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps"))
    links = materialize(own.where(F.size("reps") > 1).select("a", F.explode("reps").alias("b")), "nj")
    # against leaders, in turns: each time only shingles whose classes are not connected yet
    part = None
    for turn in range(TURNS):
        met = against_leaders(rest, turn)
        links = links.unionByName(_linked(met, docs, first, k, num, den))
        release(met), release(part)
        part = materialize(connected_components(links), "nj")
        before, rest = rest, still_open(rest, part)
        release(before)

    # what is open then: all pairs across components, of many some for each class at a time
    x, y = side(rest, "x_"), side(rest, "y_")
    met = pairs_of(x.join(y, "token").where((F.col("x_d") < F.col("y_d")) & (F.col("x_c") != F.col("y_c")) & can_match("x_", "y_")))
    each = PAIRS_EACH
    while met.count() > FEW_PAIRS:
        place = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b"), "a"))
        some = materialize(met.withColumn("at", place).where(F.col("at") <= each).select("a", "b"), "nj")
        links, each = links.unionByName(_linked(some, docs, first, k, num, den)), each * 4
        release(part)
        part = materialize(connected_components(links), "nj")
        left = met.join(some, ["a", "b"], "left_anti")
        for end in "ab":
            left = left.join(part.select(F.col("node").alias(end), F.col("component_id").alias(f"c_{end}")), end, "left")
        before, met = met, materialize(left.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b"), "nj")
        release(before), release(some)
    links = links.unionByName(_linked(met, docs, first, k, num, den))
    release(met), release(rest), release(first), release(part)
    whole = materialize(connected_components(links), "nj")
    member = classes.join(whole.select(F.col("node").alias("rep"), "component_id"), "rep", "left").select("c1", "c2", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(member, ["c1", "c2"], "left")
    own = F.when(F.col("d").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("d")))
    return out.select(F.col("d").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
