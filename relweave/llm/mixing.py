"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's texts stand in a seeded order. Targets: all words are shared by weight; a source gets at most ``most`` times
its own words, what is left over is shared again by weight among the others. Quotas go to sources in blocks of ``unit``
words by the highest quotients target / (2 s + 1); with one word a block, small sources come as near to their targets as
large ones. A quota is whole passes over its source and a rest. For the rest the source is cut into runs of ``block`` words
and these into shards; the runs that fit the rest are apportioned to shards by the same rule, and within each shard a
seeded bijection of run numbers chooses that many, and in one shard a part of one more. What is taken of a text is its
words in chosen runs, once for every pass.

Defined results: null and empty texts have size 0 and take 0; sources are ordered by code point, null is a source of
its own and the last; a source without words has target 0; reruns and other partitionings give equal results
(identical rows share one place in the order, so they may exchange their rows only); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relweave.runtime import materialize

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 32
SHARDS = 64
#: Runs of the seeded order within a shard that are numbered on their own.
RUNS = 4096


def n_words(text: Column) -> Column:
    """Number of words, without building them: the spaces between them are counted."""
    spaced = text
    for space in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    # few texts have two spaces in a row, and the pattern is what costs
    squeezed = F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, "  +", " ")).otherwise(spaced))
    return F.when(text.isNull() | (squeezed == ""), 0).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "))) + 1).cast("long")


def apportion(df: DataFrame, groups: list[str], weight: str, seats: str, out: str, cap: str | None = None) -> DataFrame:
    """Sainte-Lague: ``seats`` of each group to its rows by the highest quotients weight / (2 s + 1), at most ``cap`` each.

    Under a divisor, a row has its weight by the divisor, rounded, as seats. A few steps move each group's divisor to where
    the seats nearly add up; whatever is then still missing or too many bounds what any row has to change, since all rows
    change in one direction. Exactly those quotients are ranked. Ties go to the row that comes first by ``__order``.
    """
    by = Window.partitionBy(*groups)
    most = F.col(cap) if cap else F.col(seats)
    got = F.when(F.col("__div") > 0, F.least(F.floor(F.col(weight) / F.col("__div") + 0.5), most)).otherwise(F.lit(0)).cast("long")
    held = df.columns
    df = df.withColumn("__div", F.sum(weight).over(by) / F.greatest(F.col(seats), F.lit(1)))
    for _ in range(4):
        df = df.withColumn("__got", got).withColumn("__free", F.col("__got") < most)
        free = lambda x: F.sum(F.when(F.col("__free"), F.col(x)).otherwise(F.lit(0))).over(by)
        df = df.withColumn("__w", free(weight)).withColumn("__t", free("__got")).withColumn("__want", F.col(seats) - F.sum("__got").over(by) + F.col("__t"))
        # seats of the free rows grow as their weight by the divisor; rounding adds what it adds now
        near = F.col("__want") - F.col("__t") + F.col("__w") / F.col("__div")
        df = df.withColumn("__div", F.when((F.col("__div") > 0) & (F.col("__w") > 0) & (near > 0), F.col("__w") / near).otherwise(F.col("__div")))
        df = df.select(*held, "__div")
    df = df.withColumn("__got", got)
    # one more on either side, for quotients that rounding of floats puts on the other side of a half
    df = df.withColumn("__off", F.abs(F.col(seats) - F.sum("__got").over(by)) + 1)
    df = df.withColumn("__start", F.greatest(F.col("__got") - F.col("__off"), F.lit(0)))
    df = df.withColumn("__left", F.col(seats) - F.sum("__start").over(by))
    step = df.where(F.col(weight) > 0).withColumn("__s", F.explode(F.sequence(F.col("__start"), F.col("__got") + F.col("__off"))))
    step = step.where(F.col("__s") < most)
    step = step.withColumn("__rank", F.row_number().over(by.orderBy(F.desc(F.col(weight) / (2 * F.col("__s") + 1)), "__order", "__s")))
    extra = step.where(F.col("__rank") <= F.col("__left")).groupBy(*groups, "__order").agg(F.count("*").alias("__extra"))
    joined = df.join(extra, [*groups, "__order"], "left") if groups else df.join(extra, "__order", "left")
    return joined.select(*held, (F.col("__start") + F.coalesce("__extra", F.lit(0))).alias(out))


def source_targets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """Per source (`__source`, source_size): its order, weight and target after capping at ``most`` times its size.

    A source is capped exactly if most * size / weight is below the level that the uncapped ones reach; sorted by that
    ratio, the level is found by running sums. One row a source: small.
    """
    by_name = Window.orderBy(F.asc_nulls_last("__source"))
    n = len(weights)
    t = sizes.withColumn("__order", F.row_number().over(by_name).cast("long"))
    t = t.withColumn("__weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__order") - 1, F.lit(n)) + 1).cast("int")))
    t = t.withColumn("__cap", F.col("source_size") * float(most)).withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    rest = Window.orderBy("__ratio", "__order").rowsBetween(0, Window.unboundedFollowing)
    before = Window.orderBy("__ratio", "__order").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__ratio", "__order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # level if the sources before this one in the order are capped and the others are not
    t = t.withColumn("__total", F.sum("source_size").over(every).cast("double"))
    t = t.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__weight").over(rest))
    # the first row whose level its own ratio reaches sets the level of all after it
    first = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__order", "__level"))).over(every)
    t = t.withColumn("__first", first)
    target = F.when(F.col("__first").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__weight") * F.col("__first")["__level"]))
    return t.select("__source", "source_size", "__order", "__weight", target.alias("target"))


#: Steps of the seeded bijections of block numbers: x * step + turn runs through all of 0..n-1 where n is no multiple of step.
PRIMES = [104_729, 1_299_709, 15_485_863, 32_452_843, 49_979_687, 67_867_967, 86_028_121, 104_395_301]


def _step(n: Column, h: Column) -> Column:
    """A prime chosen by the hash among those that do not divide n; n times any of them stays far below 2^63."""
    fit = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: F.pmod(n, p) != 0)
    return F.get(fit, F.pmod(h, F.size(fit).cast("long")).cast("int"))


def mix_sources(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: list[float] | None = None,
    most: int = 3, unit: int = 1, block: int = BLOCK, shards: int = SHARDS, seed: int = 11, keep: list[str] | None = None,
) -> DataFrame:
    """``key`` (and ``keep``), size, source_size, target and taken of each row. ``weights`` repeat over the sources by code point."""
    extra = [c for c in (keep or []) if c != key]
    h = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    held = [F.struct(*extra).alias("__keep")] if extra else []  # so that no name of theirs meets one used here
    slim = df.select(key, *held, F.col(source).alias("__source"), n_words(F.col(text)).alias("size"), h.alias("__hash"))
    slim = slim.withColumn("__run", F.pmod(F.shiftrightunsigned(F.col("__hash"), 20), F.lit(RUNS)).cast("int"))
    slim = materialize(slim, "mix")
    # words of each run of each source: a bounded number of rows a source
    runs = slim.groupBy("__source", "__run").agg(F.sum("size").alias("__words"))
    ahead = Window.partitionBy("__source").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__base", F.coalesce(F.sum("__words").over(ahead), F.lit(0)))
    sizes = runs.groupBy("__source").agg(F.sum("__words").alias("source_size"))
    t = source_targets(sizes, weights or [1.0, 2.0, 3.0], most)
    t = t.withColumn("__blocks", F.ceil(F.col("source_size") / block)).withColumn("__cap", F.floor(F.col("source_size") * most / unit))
    t = t.withColumn("__all", F.floor(F.sum("target").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / unit + 0.5))
    t = apportion(t.withColumn("__one", F.lit(1)), ["__one"], "target", "__all", "__quota", "__cap").drop("__one")
    # a quota's words: whole passes over the source; of the rest whole runs and a part of one more
    t = t.withColumn("__words", F.col("__quota") * unit).withColumn("__passes", F.when(F.col("source_size") > 0, F.expr("__words div source_size")).otherwise(F.lit(0)))
    t = t.withColumn("__words", F.col("__words") - F.col("__passes") * F.col("source_size"))
    t = t.withColumn("__rest", F.expr(f"__words div {block}")).withColumn("__part", F.col("__words") % block)
    # the rest of the quota over shards, each a run of the source's blocks
    s = t.select("__source", "__order", "__blocks", "__rest", "__part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("__shard"))
    edge = lambda k: F.expr(f"(__blocks * ({k})) div {shards}")
    s = s.withColumn("__from", edge("__shard")).withColumn("__n", edge("__shard + 1") - F.col("__from"))
    s = s.select(F.col("__order").alias("__src"), F.col("__shard").cast("long").alias("__order"), "__from", "__n", "__rest", "__part")
    s = apportion(s, ["__src"], "__n", "__rest", "__take", "__n")
    n = F.greatest(F.col("__n"), F.lit(1)).cast("long")
    drawn = lambda what: F.xxhash64(F.lit(seed), F.lit(what), "__src", "__order")
    free = F.min(F.when(F.col("__take") < F.col("__n"), F.col("__order"))).over(Window.partitionBy("__src"))
    s = s.withColumn("__part", F.when(F.col("__order") == free, F.col("__part")).otherwise(F.lit(0)))
    s = s.withColumn("step", F.pmod(_step(n, drawn(1)), n)).withColumn("turn", F.pmod(drawn(2), n))
    s = s.groupBy(F.col("__src").alias("__order")).agg(F.array_sort(F.collect_list(F.struct(F.col("__order").alias("shard"), "__from", "__n", "__take", "__part", "step", "turn"))).alias("__shards"))
    t = t.join(s, "__order").drop("__weight", "__cap", "__all")
    plan = runs.select(F.col("__source").alias("__s"), F.col("__run").alias("__r"), "__base")
    # a row a source: Spark broadcasts it where its measured size is small, and else splits the hot source
    t = t.select(F.col("__source").alias("__t"), "source_size", "target", "__blocks", "__passes", F.col("__words").alias("__over"), "__shards")
    # where each text's words lie in the order of its source
    inside = Window.partitionBy("__source", "__run").orderBy("__hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("__ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(plan, placed["__source"].eqNullSafe(plan["__s"]) & (placed["__run"] == plan["__r"]))
    placed = placed.join(t, placed["__source"].eqNullSafe(t["__t"]))
    placed = placed.withColumn("__pos", F.col("__base") + F.col("__ahead"))
    first, last = F.expr(f"__pos div {block}"), F.expr(f"(__pos + size - 1) div {block}")

    def chosen(b: Column) -> Column:
        """How many of run b's first words its shard takes besides the whole passes."""
        # the first shard whose end, blocks * (k + 1) div shards, lies behind b
        k = F.ceil((b + 1) * shards / F.col("__blocks")) - 1
        mine = F.get("__shards", F.least(k, F.lit(shards - 1)).cast("int"))
        turned = F.pmod((b - mine["__from"]) * mine["step"] + mine["turn"], mine["__n"])
        return F.when(turned < mine["__take"], F.lit(block)).when(turned == mine["__take"], mine["__part"]).otherwise(F.lit(0))

    overlap = lambda b: F.greatest(F.least(F.col("__pos") + F.col("size"), b * block + chosen(b)) - F.greatest(F.col("__pos"), b * block), F.lit(0))
    picked = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, b: (acc + overlap(b)).cast("long"))
    taken = F.col("size") * F.col("__passes") + F.when((F.col("size") > 0) & (F.col("__over") > 0), picked).otherwise(F.lit(0))
    return placed.select(key, *[F.col("__keep")[c].alias(c) for c in extra], "size", "source_size", "target", taken.cast("long").alias("taken"))
