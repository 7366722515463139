"""URL filters as a sort-merge range join.

A host's labels, reversed and parted by a character below all others, followed by a second such character and the path,
make a key in which a rule is a prefix: its keys form the interval from the rule's key on. A url has one probe for each
suffix of its host that is not longer than the longest rule host (so probes a url are bounded by the rules). Rules and
probes are sorted together into ranges; every rule carries the stack of rules around it (its own prefixes among the
rules), and a running ``last`` hands each probe the rule that starts just before it. The innermost rule of that stack
whose interval is still open is the longest rule of the probe's host that fits; the longest over a url's probes wins.

Only DataFrame functions run. Rules at the start of a range come from the range before it by a small table of one row a
range. Hot hosts are spread: ranges are cut by (key, row), not by key.

Defined results: a null url or one without ``://`` has an empty host and path; no rule fits an empty host; without a rule
the verdict is ``default``; of rules with one host and path the blocking one counts; rules of equal length cannot both
fit unless their hosts differ, then the longer host wins; repeated rows are judged each; no rules or no rows are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relweave.runtime import materialize, shuffle_partitions

_LABEL, _PATH = "\x01", "\x02"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(at > 0, F.translate(host, _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    """The host's labels, in which the key's own separators are escaped."""
    for c, to in (("\x03", "\x03c"), (_LABEL, "\x03a"), (_PATH, "\x03b")):
        host = F.replace(host, F.lit(c), F.lit(to))
    return F.split(host, r"\.")


def _host_key(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), _LABEL)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack) of each rule (host, path, action): the stack holds the rules whose keys are prefixes of its own, shortest first."""
    block_first = F.when(F.col("action") == "block", 0).otherwise(1)
    r = rules.select("host", "path", "action", F.concat(_host_key(_labels(F.col("host"))), F.lit(_PATH), F.col("path")).alias("key"))
    one = r.groupBy("key").agg(F.min(F.struct(block_first.alias("o"), "host", "path", "action")).alias("r")).select("key", "r.host", "r.path", "r.action")
    own = F.struct(F.length("key").alias("size"), F.col("key").alias("prefix"), "host", "path", "action")
    inner = one.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("prefix"))
    outer = one.select(F.col("key").alias("prefix"), own.alias("rule"))
    return inner.join(outer, "prefix").groupBy("key").agg(F.array_sort(F.collect_set("rule")).alias("stack"))


def judge_urls(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """``key`` (and ``keep``), host, path, rule (like ``net/``) and verdict of each row of ``df``."""
    extra = [c for c in (keep or []) if c != key]
    ranges = shuffle_partitions(df.sparkSession)
    rows = df.select(F.struct(F.col(key), *extra).alias("__own"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    stacks = materialize(rule_stacks(rules), "rules")
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    labels = _labels(F.col("host"))
    # host suffixes of 1 to `deepest` labels, each with its probe key
    n = F.least(F.size(labels), F.lit(deepest))
    probes = F.transform(F.when((n > 0) & (F.col("host") != ""), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(_host_key(F.slice(labels, -i, i)), F.lit(_PATH), F.col("path")))
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "urls")
    asked = rows.select("__row", "host", "path", F.explode(probes).alias("key")).select("key", F.lit(1).alias("kind"), "__row", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    starts = stacks.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("__row"), "stack")
    # sorted together, in ranges of about equal numbers of rows
    events = asked.unionByName(starts).repartitionByRange(ranges, "key", "kind", "__row").withColumn("__range", F.spark_partition_id())
    events = materialize(events, "urls")
    last = events.where("kind = 0").groupBy("__range").agg(F.max_by("stack", "key").alias("stack"))
    every = df.sparkSession.range(ranges + 1).select(F.col("id").cast("int").alias("__range"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = every.join(last, "__range", "left").select("__range", F.last("stack", True).over(before).alias("stack")).where("stack is not null")
    carried = carried.select(F.lit("").alias("key"), F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("__row"), "stack", "__range")
    sweep = Window.partitionBy("__range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(carried).withColumn("active", F.last("stack", True).over(sweep)).where("kind = 1")
    fits = F.filter("active", lambda r: F.startswith(F.col("key"), r["prefix"]))
    found = swept.select("__row", F.element_at(F.when(F.size(fits) > 0, fits), -1).alias("r")).where("r is not null")
    best = found.groupBy("__row").agg(F.max(F.struct((F.length("r.host") + F.length("r.path")).alias("n"), F.length("r.host").alias("h"), F.col("r.host").alias("host"), F.col("r.path").alias("path"), F.col("r.action").alias("action"))).alias("b"))
    rule = F.concat(F.col("b.host"), F.col("b.path"))
    return rows.join(best, "__row", "left").select(*[F.col("__own")[c].alias(c) for c in [key, *extra]], "host", "path", rule.alias("rule"), F.coalesce("b.action", F.lit(default)).alias("verdict"))
