"""One query per operator of the relation engine, and its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions import bits
from relweave.functions import container as C
from relweave.operators import affine, bases, codec_sizes, containers, functional, ledger, metrics
from relweave.runtime import materialize
from relweave.sources import generators, readers


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# fixtures over the driver's tables


def int_table(spark, sf_dir) -> DataFrame:
    x, y = F.col("l_partkey"), F.col("l_suppkey")
    return _t(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"), (3 * x + 5 * y + 7).alias("z"), F.col("l_orderkey").alias("w"))


def price_table(spark, sf_dir) -> DataFrame:
    return readers.int_columns(_t(spark, sf_dir, "part"), ["p_partkey", "p_retailprice"], ["p_retailprice"]).withColumnRenamed("p_retailprice", "cents")


def geo_table(spark, sf_dir) -> DataFrame:
    s, n, r = (_t(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])


def nation_bits(spark, sf_dir) -> DataFrame:
    """16-bit records: the nation's key, then its region's."""
    v = F.col("n_nationkey").cast("long").bitwiseAND(255).bitwiseOR(F.shiftleft(F.col("n_regionkey").cast("long").bitwiseAND(255), 8))
    return _t(spark, sf_dir, "nation").select(F.array(v).alias("words"))


def parity_bits(spark, sf_dir, flipped: bool = False) -> DataFrame:
    """9-bit records: the low byte of a part key and its parity (flipped on few rows)."""
    low = F.col("l_partkey").bitwiseAND(255)
    parity = (F.bit_count(low) % 2).cast("long")
    if flipped:
        parity = F.when(F.col("l_orderkey") % 1000 == 7, 1 - parity).otherwise(parity)
    return _t(spark, sf_dir, "lineitem").select(F.array(low.bitwiseOR(F.shiftleft(parity, 8))).alias("words"))


def document_bytes(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("dataset_id"), F.encode("text", "UTF-8").alias("bytes"))


def source_blobs(spark, sf_dir) -> DataFrame:
    """The texts of each source in key order as one byte string: tens of datasets."""
    d = _t(spark, sf_dir, "documents")
    parts = d.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    return parts.select(F.col("source").alias("dataset_id"), F.encode(F.array_join(F.transform("d", lambda x: x["text"]), "\n"), "UTF-8").alias("bytes"))


def size_rows(spark, sf_dir) -> DataFrame:
    """A table of codec sizes derived from documents: made-up codecs whose sizes are integer functions of the texts."""
    d = _t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("n"), F.count("*").alias("m"))
    d = d.withColumn("dataset_id", F.concat_ws("/", "lang", "source"))
    forms = [("raw", "one", "n div 2 + 40"), ("raw", "two", "n div 3 + m * 90"), ("composed", "one", "n div 2 - 7 * m"), ("composed", "three", "n div 4 + m")]
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(c).alias("codec"), F.expr(e).cast("long").alias("bytes"), F.expr("m > 2 or '%s' <> 'two'" % c).alias("available")) for s, c, e in forms]))
    return d.select("dataset_id", "n", "m", rows.alias("r")).select("dataset_id", "n", "m", "r.*")


_SIZE_SQL = """
d as (select lang || '/' || source as dataset_id, sum(n_chars)::bigint as n, count(*) as m from documents group by lang, source),
sizes as (select dataset_id, 'raw' as side, 'one' as codec, n // 2 + 40 as bytes, true as available from d
  union all select dataset_id, 'raw', 'two', n // 3 + m * 90, m > 2 from d
  union all select dataset_id, 'composed', 'one', n // 2 - 7 * m, true from d
  union all select dataset_id, 'composed', 'three', n // 4 + m, true from d),
ok as (select * from sizes where available),
best as (select dataset_id, min(bytes) filter (where side = 'raw') as raw_best, min(bytes) filter (where side = 'composed') as composed_best from ok group by 1),
matched as (select r.dataset_id, min(r.bytes) as mraw, min(r.bytes) - min(c.bytes) as mgap from ok r join ok c on r.dataset_id = c.dataset_id and r.codec = c.codec and r.side = 'raw' and c.side = 'composed' group by 1)
"""


def result_rows(spark, sf_dir) -> DataFrame:
    """One result a dataset of size_rows."""
    r = size_rows(spark, sf_dir).select("dataset_id", "n", "m").distinct()
    return r.select(
        "dataset_id", F.col("n").alias("dataset_bytes"), F.when(F.col("m") % 4 == 0, "PASSTHROUGH").otherwise("GF2").alias("codec_kind"), F.when(F.col("m") % 4 == 0, 0).otherwise(F.col("m")).cast("int").alias("n_relations"),
        (F.col("m") * 8).alias("recovered_bits"), F.expr("n div 3 + 18").alias("total_encoded_bytes"), (F.col("m") % 7 != 0).alias("roundtrip_ok"), (F.col("m") % 5 != 0).alias("composed_roundtrip_ok"),
    )


# integer-affine relations


def affine_bivariate(spark, sf_dir):
    df = int_table(spark, sf_dir)
    return affine.relations_frame(df, affine.discover_affine(df, ["x", "y", "z", "w"])[1])


def affine_univariate(spark, sf_dir):
    x = F.col("l_partkey")
    df = _t(spark, sf_dir, "lineitem").select(x.alias("x"), (7 * x - 13).alias("z"))
    return affine.relations_frame(df, affine.discover_affine(df, ["x", "z"])[1])


def affine_scale_dependent(spark, sf_dir):
    df = price_table(spark, sf_dir)
    return affine.relations_frame(df, affine.discover_affine(df, ["p_partkey", "cents"])[1])


def affine_violations(spark, sf_dir):
    r = affine.AffineRelation("cents", "p_partkey", None, 10, 0, 90000)
    value = r.expression()
    return price_table(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_if(~value.eqNullSafe(F.col("cents").cast("decimal(38,0)"))).alias("n_violations"))


def affine_none(spark, sf_dir):
    df = readers.int_columns(_t(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], ["o_totalprice"])
    left, found = affine.discover_affine(df, ["o_orderkey", "o_custkey", "o_totalprice"])
    return spark.createDataFrame([(len(left), len(found))], "n_independent int, n_relations int")


def affine_independents(spark, sf_dir):
    left, _ = affine.discover_affine(int_table(spark, sf_dir), ["z", "x", "w", "y"])
    return spark.createDataFrame([(i, c) for i, c in enumerate(left)], "ordinal int, column_name string")


def affine_apply(spark, sf_dir):
    df = int_table(spark, sf_dir).select("x", "y")
    made = affine.apply_relations(df, [affine.AffineRelation("u", "z", "y", 2, -1, 3), affine.AffineRelation("z", "x", "y", 3, 5, 7)])
    return made.groupBy("y").agg(F.sum("z").alias("sum_z"), F.sum("u").alias("sum_u"), F.count("*").alias("n"))


# functional dependencies


def fd_unary(spark, sf_dir):
    df, cols = geo_table(spark, sf_dir), ["s_nationkey", "n_regionkey", "n_name", "r_name"]
    rows = []
    for s in cols:
        n, ok = functional.grouped_by(df, [s], [c for c in cols if c != s])
        rows += [(s, z, n, holds) for z, holds in ok.items()]
    return spark.createDataFrame(rows, "source string, target string, n_entries long, holds boolean")


def _shipping(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("ship_year"), "l_returnflag", "l_linestatus", F.col("l_linenumber"))


def fd_binary(spark, sf_dir):
    df, rows = _shipping(spark, sf_dir), []
    for s in (["ship_year", "l_returnflag"], ["ship_year", "l_linestatus"], ["l_returnflag", "l_linestatus"]):
        targets = [c for c in ("ship_year", "l_returnflag", "l_linestatus", "l_linenumber") if c not in s]
        n, ok = functional.grouped_by(df, s, targets)
        rows += [(",".join(s), z, n, holds) for z, holds in ok.items()]
    return spark.createDataFrame(rows, "sources string, target string, n_entries long, holds boolean")


def fd_lookup(spark, sf_dir):
    return functional.lookup_table(geo_table(spark, sf_dir), "n_regionkey", ["s_nationkey"])


def fd_cost(spark, sf_dir):
    df = geo_table(spark, sf_dir)
    n, _ = functional.grouped_by(df, ["s_nationkey"], ["n_regionkey"])
    d = functional.Dependency("n_regionkey", ("s_nationkey",), n)
    return spark.createDataFrame([(n, d.cost_bits(64, [64]))], "n_entries long, cost_bits long")


def fd_greedy(spark, sf_dir):
    found = functional.discover_maps(geo_table(spark, sf_dir), ["s_nationkey", "n_regionkey", "n_name", "r_name"])
    return spark.createDataFrame([(d.z, ",".join(d.sources), d.n_entries) for d in found], "target string, sources string, n_entries long")


# GF(2) bases


def gf2_rank_w16(spark, sf_dir):
    return bases.column_basis(nation_bits(spark, sf_dir), 16).select("affine", "n_rows", "rank", "n_relations")


def gf2_rank_w8(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").select(F.array(F.col("n_nationkey").cast("long").bitwiseAND(255)).alias("words"))
    return bases.column_basis(rows, 8).select("affine", "n_rows", "rank", "n_relations")


def gf2_free_columns(spark, sf_dir):
    return bases.column_basis(nation_bits(spark, sf_dir), 16).where("not affine").select(F.explode("free").alias("free_col"))


def gf2_pivots(spark, sf_dir):
    return bases.column_basis(nation_bits(spark, sf_dir), 16).where("not affine").select(F.explode("pivots").alias("pivot_col"))


def gf2_coefficients(spark, sf_dir):
    return bases.edges(bases.column_basis(parity_bits(spark, sf_dir), 9)).where("not affine").select("free_col", "pivot_col")


def gf2_near_relation(spark, sf_dir):
    return bases.column_basis(parity_bits(spark, sf_dir, flipped=True), 9).where("not affine").select("rank", "n_relations")


def gf2_verify(spark, sf_dir):
    exact = bases.violations(parity_bits(spark, sf_dir), [([0x1FF], False), ([0x1FF], True)]).withColumn("near", F.lit(False))
    return exact.unionByName(bases.violations(parity_bits(spark, sf_dir, True), [([0x1FF], False)]).withColumn("near", F.lit(True)))


def gf2_reconstruct(spark, sf_dir):
    rows = parity_bits(spark, sf_dir)
    b = bases.column_basis(rows, 9).where("not affine").first()
    back = bases.rebuilt(F.col("words"), b["pivots"], b["free"], b["masks"], b["const"], 9)
    return rows.select("words", back.alias("back")).agg(F.count_if(F.col("words") != F.col("back")).alias("n_different"), F.sum(F.get("back", 0)).alias("sum_rebuilt"), F.count("*").alias("n_rows"))


def gf2_bases_wide(spark, sf_dir):
    return bases.bases(source_blobs(spark, sf_dir)).select("dataset_id", "width", "affine", "n_rows", "rank", "n_relations")


def gf2_bases_offsets(spark, sf_dir):
    return bases.bases(source_blobs(spark, sf_dir), C.configurations(offsets=C.ALL_OFFSETS)).select("dataset_id", "width", "offset", "affine", "n_rows", "rank", "n_relations")


# reshaping and the size model


def bit_rows(spark, sf_dir):
    """Every text cut into records by the reshaper."""

    def run(batches):
        for b in batches:
            rows = []
            for d, x in zip(b["dataset_id"], b["bytes"], strict=True):
                for w, o in ((8, 0), (17, 0), (48, 5), (64, 13), (256, 0)):
                    matrix, prefix, leftover = bits.reshape(x, w, o)
                    rows.append((d, w, o, len(matrix), len(leftover), len(prefix)))
            yield pd.DataFrame(rows, columns=["dataset_id", "width", "offset", "n_rows", "leftover_bits", "prefix_bits"])

    return document_bytes(spark, sf_dir).where("bytes is not null").mapInPandas(run, "dataset_id string, width int, offset int, n_rows long, leftover_bits long, prefix_bits long")


def passthrough_size(spark, sf_dir):
    made = containers.encode_passthrough(document_bytes(spark, sf_dir))
    return made.select("dataset_id", F.octet_length("bytes").cast("long").alias("container_bytes"), F.sha2("bytes", 256).alias("sha256")).select("dataset_id", "container_bytes")


def gf2_size_model(spark, sf_dir):
    d = document_bytes(spark, sf_dir).select("dataset_id", F.octet_length("bytes").cast("long").alias("total"))
    found = d.select("dataset_id", F.lit(64).alias("width"), F.lit(3).alias("offset"), F.expr("(8 * total - 3) div 64").alias("n_rows"), F.lit(60).alias("rank"), F.lit(4).alias("n_relations"), F.lit(61).alias("coeff_width"))
    return containers.with_sizes(found, d).select("dataset_id", "passthrough_bytes", "container_bytes")


def best_config(spark, sf_dir):
    return containers.best_configurations(source_blobs(spark, sf_dir))


# containers


def _planted(spark):
    """Golden datasets, generated on the executors, with containers of known sizes."""
    codes = generators.generate(spark, generators.gf2_linear_code, [
        {"n_rows": 1280, "n_info": 32, "n_parity": 32, "seed": 902}, {"n_rows": 4096, "n_info": 32, "n_parity": 32, "seed": 12}, {"n_rows": 8192, "n_info": 48, "n_parity": 48, "seed": 777},
    ])
    return codes


def planted_datasets(spark, sf_dir):
    made = _planted(spark).unionByName(generators.generate(spark, generators.exact_functional_table, [{"n_rows": 8192, "seed": 21, "fn": "affine"}]))
    made = made.unionByName(generators.generate(spark, generators.gf2_linear_code, [{"n_rows": 65536, "n_info": 64, "n_parity": 64, "seed": 14}]))
    return made.select("dataset_id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"))


#: Widths that the golden container sizes were made with.
_PLANTED_WIDTHS = {"gf2_n1280_k32_p32_s902": 64, "gf2_n4096_k32_p32_s12": 64, "gf2_n8192_k48_p48_s777": 96}


def planted_containers(spark, sf_dir):
    sets = _planted(spark)
    out = None
    for name, width in _PLANTED_WIDTHS.items():
        one = containers.encode_configuration(sets.where(F.col("dataset_id") == name), width)
        out = one if out is None else out.unionByName(one)
    return out.select("dataset_id", "kind", "n_relations", F.octet_length("bytes").cast("long").alias("container_bytes"))


def _all_sets(spark, sf_dir) -> DataFrame:
    """The sources' texts and the planted datasets."""
    return materialize(source_blobs(spark, sf_dir).unionByName(_planted(spark).select("dataset_id", "bytes")), "sets")


def container_roundtrip(spark, sf_dir):
    sets = _all_sets(spark, sf_dir)
    made = materialize(containers.encode_best(sets), "made")
    return containers.round_trips(sets, made)


def container_accounting(spark, sf_dir):
    made = containers.encode_best(_all_sets(spark, sf_dir))
    return made.select("dataset_id", "kind", "config", "n_relations", "recovered_bits", F.octet_length("bytes").cast("long").alias("container_bytes"), "account.*")


def size_model_matches(spark, sf_dir):
    """Closed-form sizes against the built containers."""
    sets = _all_sets(spark, sf_dir)
    made = containers.encode_best(sets).select("dataset_id", F.octet_length("bytes").cast("long").alias("built"))
    return containers.best_configurations(sets).select("dataset_id", "container_bytes").join(made, "dataset_id").select("dataset_id", (F.col("built") == F.col("container_bytes")).alias("ok"))


def table_container(spark, sf_dir):
    """A table through its container and back: sums of the values times their row numbers, so that order counts."""
    x, y = F.col("l_partkey"), F.col("l_suppkey")
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), (3 * x + 5 * y + 7).alias("z"), F.col("l_orderkey").alias("w"))
    # lineitem has rows of one order and line; those that share all of these columns are equal here
    made = materialize(containers.encode_table(df, ["x", "y", "z", "w"], ["l_orderkey", "l_linenumber", "x", "y"]), "table")
    back = containers.decode_table(made, ["x", "y", "z", "w"])
    sums = materialize(back.agg(F.count("*").alias("n_rows"), *[F.sum(((F.col("row_id") + 1) * F.col(c)).cast("decimal(20,0)")).alias(f"sum_{c}") for c in "xyzw"]), "sums")
    # whole numbers of 64 bits, or of more digits where a sum needs them
    whole = {c: F.col(c).cast("long") for c in sums.columns if c != "n_rows"}
    wide = sums.where(" or ".join(f"abs({c}) > {2**63 - 1}" for c in whole)).count()
    return sums if wide else sums.withColumns(whole)


def crc32_records(spark, sf_dir):
    sets = generators.to_frame(spark, [generators.crc_records(4096, 5)]).select("dataset_id", "bytes")
    return bases.bases(sets, [(64, 0, False), (64, 0, True)]).select("dataset_id", "affine", "n_rows", "n_relations")


# codecs, metrics, ledger


def stock_codec_sizes(spark, sf_dir):
    return codec_sizes.codec_sizes(materialize(source_blobs(spark, sf_dir), "sets")).select("dataset_id", "side", "codec", "bytes", "available")


def composed_gap(spark, sf_dir):
    sets = _all_sets(spark, sf_dir)
    made = materialize(containers.encode_best(sets), "made")
    return metrics.gaps(materialize(codec_sizes.sizes_of_both(sets, made), "sizes"))


def composed_roundtrip(spark, sf_dir):
    sets = _all_sets(spark, sf_dir)
    return codec_sizes.composed_roundtrips(materialize(containers.encode_best(sets), "made"), sets)


def gap_metrics(spark, sf_dir):
    return metrics.gaps(size_rows(spark, sf_dir)).select("dataset_id", "raw_best_bytes", "composed_best_bytes", "gap_bytes", "gap_pct")


def matched_gap(spark, sf_dir):
    return metrics.gaps(size_rows(spark, sf_dir)).select("dataset_id", "matched_gap_bytes", "matched_gap_pct", "codec_sets_match", "available_raw_codecs")


def claims_abc(spark, sf_dir):
    c = metrics.with_claims(result_rows(spark, sf_dir), metrics.gaps(size_rows(spark, sf_dir)), ["en/src0"])
    return c.select("dataset_id", "claim_a", "claim_b", "claim_c", "meaningful", "reportable")


def verdict(spark, sf_dir):
    c = metrics.with_claims(result_rows(spark, sf_dir), metrics.gaps(size_rows(spark, sf_dir)))
    return metrics.with_verdict(c).select("dataset_id", "verdict")


def outcome(spark, sf_dir):
    c = metrics.with_claims(result_rows(spark, sf_dir), metrics.gaps(size_rows(spark, sf_dir)))
    return metrics.outcome(c, spark.createDataFrame([("framing", True)], "gate string, passed boolean"))


def companion_metrics(spark, sf_dir):
    r = result_rows(spark, sf_dir).withColumns({"raw_gap_bytes": F.expr("dataset_bytes div 5 - total_encoded_bytes"), "relation_bits": F.col("n_relations") * 64, "total_bits": 8 * F.col("total_encoded_bytes")})
    return metrics.with_companions(r).select("dataset_id", "bits_per_byte_gap", "recovered_fraction", "description_ratio", "overhead_fraction")


def monotone_sweep(spark, sf_dir):
    s = _t(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 10).alias("phi")).agg(F.sum("n_chars").alias("gap_bytes"))
    return metrics.monotone_sweep(s, slack=2000).select("phi", "gap_bytes", "previous", "passed")


def offset_vs_phase0(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").groupBy("source").agg((F.sum("n_chars") % 2001 - 1000).alias("gap_bytes"), (F.max("n_chars") % 601 - 300).alias("zero"))
    zero = d.select(F.when(F.col("zero") % 2 == 0, F.col("source")).otherwise(F.concat("source", F.lit("@slice"))).alias("dataset_id"), F.col("zero").alias("gap_bytes"))
    return metrics.against_phase_zero(d.select(F.col("source").alias("dataset_id"), "gap_bytes"), zero)


def manifest_pin(spark, sf_dir):
    sets = document_bytes(spark, sf_dir)
    old = sets.where("cast(dataset_id as bigint) % 3 = 0")
    return readers.pin_or_verify(sets, readers.pin_or_verify(old, None))


def _records(spark, sf_dir):
    """Records made of size_rows, in the stored schema."""
    s = size_rows(spark, sf_dir)
    side = lambda x: F.collect_list(F.when(F.col("side") == x, F.struct(F.col("codec").alias("name"), "bytes", F.lit(0.0).alias("seconds"), "available", F.lit("").alias("notes"))))
    r = s.groupBy("dataset_id").agg(side("raw").alias("baselines"), side("composed").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    j = r.select(F.to_json(F.struct(
        F.col("dataset_id").alias("experiment_id"), F.lit("natural").alias("phase"), "dataset_id", F.col("n").alias("dataset_bytes"), F.lit("GF2").alias("codec_kind"), F.col("m").alias("n_relations"),
        F.struct((F.col("m") * 8).alias("payload_bits"), F.col("m").alias("relation_description_bits"), F.lit(216).alias("header_bits"), F.lit(3).alias("framing_bits"), F.lit(32).alias("crc_bits"), F.lit(32).alias("leftover_bits"), (8 * F.col("m") + 8 * (F.col("m") % 2)).alias("total_bits")).alias("accounting"),
        F.col("m").alias("total_encoded_bytes"), F.lit(True).alias("roundtrip_ok"), "baselines", F.map_from_entries(F.transform("c", lambda x: F.struct(x["name"], x))).alias("composition"),
    )).alias("j"))
    return j.select(F.from_json("j", ledger.RECORD).alias("r")).select("r.*")


def ledger_flatten(spark, sf_dir):
    flat = ledger.flatten(_records(spark, sf_dir), ["one", "two", "three"])
    return flat.select("experiment_id", "baseline_one", "baseline_two", "composed_one", "composed_three", "gap_bytes", "raw_gap_bytes", "metadata_bits", "accounting_ok", "composed_state")


def ledger_summary(spark, sf_dir):
    return ledger.summary(ledger.flatten(_records(spark, sf_dir), ["one"]))


def ledger_report(spark, sf_dir):
    return ledger.report(ledger.flatten(_records(spark, sf_dir), ["one"]), ["natural"], "GF2").select("experiment_id", "n_relations", "gap_bytes")


def check_claims(spark, sf_dir):
    """Markers of every type, right and wrong ones; a whole number that is off by one is wrong however large it is."""
    flat = ledger.flatten(_records(spark, sf_dir), ["one"]).withColumn("large", F.lit(10_000_000).cast("long") + F.col("dataset_bytes"))
    mark = lambda field, value: F.concat(F.lit("Some text <!-- src: "), "experiment_id", F.lit(f" / {field} = "), value, F.lit(" -->."))
    text = lambda c: F.col(c).cast("string")
    quoted = [mark("gap_bytes", text("gap_bytes")), mark("large", (F.col("large") + 1).cast("string")), mark("gap_pct", F.format_string("%.8f", "gap_pct")), mark("gap_pct", F.format_string("%.8f", F.col("gap_pct") + 0.001)),
              mark("codec_kind", F.lit("GF2")), mark("codec_kind", F.lit("gf2")), mark("roundtrip_ok", F.lit("True")), mark("roundtrip_ok", F.lit("1")), mark("no_such_field", F.lit("1")), mark("verdict", F.lit("None"))]
    lines = flat.select(F.posexplode(F.array(*quoted)).alias("line_no", "line"))
    lines = lines.unionByName(spark.createDataFrame([(99, "written as <!-- src: id / field = value -->")], "line_no int, line string"))
    return ledger.check_claims(lines, flat).select("line_no", "experiment_id", "field", "ok")


def ledger_rollup(spark, sf_dir):
    flat = ledger.flatten(_records(spark, sf_dir), ["one"])
    lang, source = F.get(F.split("experiment_id", "/"), 0).alias("lang"), F.get(F.split("experiment_id", "/"), 1).alias("source")
    return ledger.rollup(flat.select(lang, source, "gap_bytes"), ["lang", "source"])


def xor_rows(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.array(F.col("l_orderkey"), F.col("l_partkey") * 64 + F.col("l_linenumber")).alias("words"))
    return bases.xor_rows(rows, ["l_returnflag"], 2).select("l_returnflag", F.get("words", 0).alias("xor_order"), F.get("words", 1).alias("xor_part"), "n_rows")


def control_gates(spark, sf_dir):
    """All gates over the controls made for them: a planted code, noise, a code with ever more flipped bits, an unsearched record length."""
    rng = np.random.default_rng(40)
    code = generators.gf2_linear_code(1280, 32, 32, 902)
    sets = [("positive", 0.0, code), ("composed", 0.0, code), ("null", 0.0, generators.mixed_noise_bits(512, 64, 1)), ("period", 0.0, generators.odd_period_code())]
    sets += [("noise", 0.0, generators.Dataset(f"noise{i}", rng.integers(0, 256, 4096, dtype=np.uint8).tobytes())) for i in range(metrics.NOISE_INPUTS)]
    sets += [("sweep", phi, generators.corrupted_gf2_code(4096, 32, 32, 433, phi)) for phi in (0.0, 1e-4, 1e-3, 1e-2, 5e-2)]
    frame = spark.createDataFrame([(f"{c}/{d.dataset_id}/{phi:g}", c, phi, bytearray(d.data)) for c, phi, d in sets], "dataset_id string, control string, phi double, bytes binary")
    own = frame.where("control = 'period'").withColumns({"control": F.lit("own_period"), "dataset_id": F.lit("own_period")})
    found = ledger.measure(frame.select("dataset_id", "bytes"), "controls")
    at_48 = ledger.measure(own.select("dataset_id", "bytes"), "controls", C.configurations((48, 96, *C.WIDTHS)))
    both = frame.unionByName(own).select("dataset_id", "control", "phi").join(found.unionByName(at_48), "dataset_id")
    return metrics.control_gates(both, metrics.GATES + metrics.MORE_GATES)


def harness(spark, sf_dir):
    sets = _all_sets(spark, sf_dir)
    out = ledger.measure(sets, "all")
    return out.select("dataset_id", "codec_kind", "n_relations", "total_encoded_bytes", "roundtrip_ok", "accounting_ok", "composed_roundtrip_ok", "claim_a", "claim_b", "claim_c", "meaningful")


def structured_text(spark, sf_dir):
    sets = [generators.Dataset("json", generators.json_sums(2000, 3)), generators.Dataset("log", generators.log_totals(2000, 4)), generators.Dataset("csv", generators.csv_sums(2000, 6))]
    return containers.best_configurations(generators.to_frame(spark, sets).select("dataset_id", "bytes"))


QUERIES = {f.__name__: f for f in (
    affine_bivariate, affine_univariate, affine_scale_dependent, affine_violations, affine_none, affine_independents, affine_apply, fd_unary, fd_binary, fd_lookup, fd_cost, fd_greedy,
    gf2_rank_w16, gf2_rank_w8, gf2_free_columns, gf2_pivots, gf2_coefficients, gf2_near_relation, gf2_verify, gf2_reconstruct, gf2_bases_wide, gf2_bases_offsets, bit_rows, passthrough_size,
    gf2_size_model, best_config, planted_datasets, planted_containers, container_roundtrip, container_accounting, size_model_matches, table_container, crc32_records, stock_codec_sizes, composed_gap,
    composed_roundtrip, gap_metrics, matched_gap, claims_abc, verdict, outcome, companion_metrics, monotone_sweep, offset_vs_phase0, manifest_pin, ledger_flatten, ledger_summary, ledger_report,
    check_claims, harness, structured_text, ledger_rollup, xor_rows, control_gates,
)}


def _dual(rows: str, width: int) -> str:
    """Annihilators of the row space: masks whose parity is even on every row; and those of constant parity."""
    return f"""with rows as ({rows}), masks as (select unnest(generate_series(0, {2**width - 1}))::bigint as m),
par as (select m, count(*) filter (where bit_count(v & m) % 2 = 1) as odd, count(*) as n from masks, rows group by m),
ann as (select m from par where odd = 0), con as (select m from par where odd = 0 or odd = n)"""


_NATION16 = "select distinct ((n_nationkey & 255) | ((n_regionkey & 255) << 8))::bigint as v from nation"
_NATION8 = "select distinct (n_nationkey & 255)::bigint as v from nation"
_LOW = "(l_partkey & 255)"
_PARITY = f"(bit_count({_LOW}) % 2)"
_EXACT9 = f"select distinct ({_LOW} | ({_PARITY}::bigint << 8))::bigint as v from lineitem"
_NEAR = f"case when l_orderkey % 1000 = 7 then 1 - {_PARITY} else {_PARITY} end"
_NEAR9 = f"select distinct ({_LOW} | (({_NEAR})::bigint << 8))::bigint as v from lineitem"
_GEO = "geo as (select s.*, n.*, r.* from supplier s join nation n on s_nationkey = n_nationkey join region r on n_regionkey = r_regionkey)"
_RANK = "select affine, (select count(*) from {t})::bigint as n_rows, ({w} - k)::int as rank, k::int as n_relations from (select false as affine, log2(count(*)) as k from ann union all select true, log2(count(*)) from con)"
_PRICE = "price as (select p_partkey as x, round(p_retailprice * 100)::bigint as z from part)"
_UNI = """, e as (select min(x) as x0, max(x) as x1, min_by(z, x) as z0, max_by(z, x) as z1 from price),
s as (select (z1 - z0) // (x1 - x0) as a, z0 - (z1 - z0) // (x1 - x0) * x0 as c from e where (z1 - z0) % (x1 - x0) = 0)
select 'cents' as z_col, 'p_partkey' as x_col, null::varchar as y_col, a::bigint as a, 0::bigint as b, c::bigint as c from s where not exists (select 1 from price where a * x + c != z)"""


def _fd(pairs: list[tuple[str, str]], table: str, source: str = "source") -> str:
    one = [f"select '{s}' as {source}, '{z}' as target, count(distinct ({s},))::bigint as n_entries, count(distinct ({s},)) = count(distinct ({s}, {z})) as holds from {table}" for s, z in pairs]
    return " union all ".join(one)


_GEO_COLS = ["s_nationkey", "n_regionkey", "n_name", "r_name"]
_SHIP = "ship as (select year(l_shipdate) as ship_year, l_returnflag, l_linestatus, l_linenumber from lineitem)"
_SHIP_PAIRS = [(f"{a},{b}", z) for a, b in (("ship_year", "l_returnflag"), ("ship_year", "l_linestatus"), ("l_returnflag", "l_linestatus")) for z in ("ship_year", "l_returnflag", "l_linestatus", "l_linenumber") if z not in (a, b)]
_RESULTS = """, res as (select dataset_id, n as dataset_bytes, case when m % 4 = 0 then 'PASSTHROUGH' else 'GF2' end as kind, case when m % 4 = 0 then 0 else m end as rels, m * 8 as rec, n // 3 + 18 as enc, m % 7 != 0 as rt, m % 5 != 0 as crt from d)"""
_BYTES = "(select doc_id::varchar as dataset_id, octet_length(encode(text)) as n from documents)"
_CLAIMS = """, cl as (select res.*, raw_best, composed_best, raw_best - composed_best as gap, mgap, mraw, raw_best - enc as rgap, s1.cs = s2.cs as same,
  rels >= 1 as claim_a, enc < dataset_bytes + 18 and raw_best - enc > 0 as claim_b, raw_best - composed_best > 0 as claim_c
  from res join best using (dataset_id) left join matched using (dataset_id)
  join (select dataset_id, list_sort(list(codec)) as cs from ok where side = 'raw' group by 1) s1 using (dataset_id) join (select dataset_id, list_sort(list(codec)) as cs from ok where side = 'composed' group by 1) s2 using (dataset_id)),
me as (select *, claim_c and gap >= 1024 and gap::double / raw_best >= 0.05 and rt and not (kind = 'PASSTHROUGH' or rels = 0) and rec >= 1 as mean0 from cl)"""
_REPORTABLE = "crt and (same or coalesce(mgap >= 1024 and mgap::double / mraw >= 0.05, false))"

_SETS = "select distinct source as dataset_id from documents union all select unnest(['gf2_n1280_k32_p32_s902', 'gf2_n4096_k32_p32_s12', 'gf2_n8192_k48_p48_s777'])"

ORACLE_SQL: dict[str, str] = {
    "affine_bivariate": """with t as (select l_partkey as x, l_suppkey as y, 3 * l_partkey + 5 * l_suppkey + 7 as z from lineitem),
p as (select min({x: x, y: y, z: z}) as p, max({x: x, y: y, z: z}) as q from t),
r as (select max_by({x: x, y: y, z: z}, abs((x - p.x) * (q.y - p.y) - (y - p.y) * (q.x - p.x))) as r from t, p),
v as (select q.x - p.x as ax, q.y - p.y as ay, q.z - p.z as az, r.x - p.x as bx, r.y - p.y as by_, r.z - p.z as bz, p.x as px, p.y as py, p.z as pz from p, r),
s as (select (az * by_ - bz * ay) // (ax * by_ - ay * bx) as a, (ax * bz - bx * az) // (ax * by_ - ay * bx) as b, px, py, pz from v where ax * by_ != ay * bx)
select 'z' as z_col, 'x' as x_col, 'y' as y_col, a::bigint as a, b::bigint as b, (pz - a * px - b * py)::bigint as c from s where not exists (select 1 from t where a * x + b * y + pz - a * px - b * py != z)""",
    "affine_univariate": "with price as (select l_partkey as x, 7 * l_partkey - 13 as z from lineitem)" + _UNI.replace("'cents'", "'z'").replace("'p_partkey'", "'x'"),
    "affine_scale_dependent": "with " + _PRICE + _UNI,
    "affine_violations": "select count(*) as n_rows, count(*) filter (where round(p_retailprice * 100)::bigint != 90000 + 10 * p_partkey) as n_violations from part",
    "affine_apply": "with t as (select l_suppkey as y, 3 * l_partkey + 5 * l_suppkey + 7 as z from lineitem) select y, sum(z)::bigint as sum_z, sum(2 * z - y + 3)::bigint as sum_u, count(*) as n from t group by y",
    "fd_unary": f"with {_GEO} " + _fd([(s, z) for s in _GEO_COLS for z in _GEO_COLS if s != z], "geo"),
    "fd_binary": f"with {_SHIP} " + _fd(_SHIP_PAIRS, "ship", "sources"),
    "fd_lookup": f"with {_GEO} select distinct s_nationkey, n_regionkey from geo",
    "fd_cost": f"with {_GEO} select count(distinct s_nationkey)::bigint as n_entries, (32 + count(distinct s_nationkey) * 128)::bigint as cost_bits from geo",
    "fd_greedy": f"""with {_GEO}, cap as (select greatest(1, count(*) // 2) as cap from geo), f as ({_fd([("s_nationkey", z) for z in _GEO_COLS[1:]], "geo", "sources")})
select target, sources, n_entries from f, cap where holds and n_entries <= cap""",
    "gf2_rank_w16": _dual(_NATION16, 16) + " " + _RANK.format(t="nation", w=16),
    "gf2_rank_w8": _dual(_NATION8, 8) + " " + _RANK.format(t="nation", w=8),
    "gf2_free_columns": _dual(_NATION16, 16) + " select distinct floor(log2(m))::int as free_col from ann where m > 0",
    "gf2_pivots": _dual(_NATION16, 16) + " select c::int as pivot_col from (select unnest(generate_series(0, 15)) as c) where c not in (select floor(log2(m)) from ann where m > 0)",
    "gf2_coefficients": _dual(_EXACT9, 9) + """, free as (select distinct floor(log2(m))::int as f from ann where m > 0), one as (select f, m from free, ann where m > 0 and floor(log2(m)) = f and not exists (select 1 from free g where g.f != free.f and (m >> g.f) & 1 = 1))
select f as free_col, c::int as pivot_col from one, (select unnest(generate_series(0, 8)) as c) where c != f and (m >> c) & 1 = 1""",
    "gf2_near_relation": _dual(_NEAR9, 9) + " select (9 - log2(count(*)))::int as rank, log2(count(*))::int as n_relations from ann",
    "gf2_verify": f"""select 0 as relation, count(*) filter (where bit_count({_LOW} | ({_PARITY}::bigint << 8)) % 2 = 1) as n_violations, false as near from lineitem
union all select 1, count(*) filter (where bit_count({_LOW} | ({_PARITY}::bigint << 8)) % 2 = 0), false from lineitem
union all select 0, count(*) filter (where bit_count({_LOW} | (({_NEAR})::bigint << 8)) % 2 = 1), true from lineitem""",
    "gf2_reconstruct": f"select 0::bigint as n_different, sum({_LOW} | ({_PARITY}::bigint << 8))::bigint as sum_rebuilt, count(*) as n_rows from lineitem",
    "bit_rows": f"""select dataset_id, w as width, o as "offset", greatest(8 * n - o, 0) // w as n_rows, greatest(8 * n - o, 0) % w as leftover_bits, least(o, 8 * n) as prefix_bits
from {_BYTES}, (values (8, 0), (17, 0), (48, 5), (64, 13), (256, 0)) c(w, o)""",
    "passthrough_size": f"select dataset_id, n + 18 as container_bytes from {_BYTES}",
    "gf2_size_model": f"select dataset_id, n + 18 as passthrough_bytes, ceil((280 + (8 * n - 3) % 64 + 35 + 64 + 4 * 61 + (8 * n - 3) // 64 * 60) / 8.0)::bigint as container_bytes from {_BYTES}",
    "planted_datasets": """select * from (values ('gf2_n1280_k32_p32_s902', 10240::bigint, 'c78ca4eb1e539975d9aa8b76779a790da3ab91af027b14de14c2d22c1f4b97d6'),
('gf2_n4096_k32_p32_s12', 32768, 'ddf23fa518129c14d6cdb1fed067de7cbf5aec8e8d2e2d3d762d53dd271f1615'), ('gf2_n8192_k48_p48_s777', 98304, '89e0d8c75a499985ee5ca382ac6faeb9cbf74b9b3f3b2276ddef43a14324fd0c'),
('gf2_n65536_k64_p64_s14', 1048576, '9e300c474c1358cce32559616193d51a5d8fdcd9715bd671928dc42c7dd09e09'), ('fd_affine_n8192_s21', 196608, '4f6c208becf02ec8d4ea5c77a4c922362a5ed886b84b550d547b400518e30ec7')) t(dataset_id, n_bytes, sha256)""",
    "planted_containers": "select * from (values ('gf2_n1280_k32_p32_s902', 'GF2', 32, 5291::bigint), ('gf2_n4096_k32_p32_s12', 'GF2', 32, 16555), ('gf2_n8192_k48_p48_s777', 'GF2', 48, 49487)) t(dataset_id, kind, n_relations, container_bytes)",
    "table_container": """with t as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as r, l_partkey as x, l_suppkey as y, l_orderkey as w from lineitem)
select count(*) as n_rows, sum(r * x)::bigint as sum_x, sum(r * y)::bigint as sum_y, sum(r * (3 * x + 5 * y + 7))::bigint as sum_z, sum(r * w)::bigint as sum_w from t""",
    "container_roundtrip": f"select dataset_id, true as roundtrip_ok, true as accounting_ok, true as framing_ok from ({_SETS})",
    "size_model_matches": f"select dataset_id, true as ok from ({_SETS})",
    # a CRC of 32 bits is an affine map of its payload: 32 relations with constants, of which one more is spent on making constants vanish
    "crc32_records": "select * from (values ('crc_n4096_b4_s5', false, 4096::bigint, 31), ('crc_n4096_b4_s5', true, 4096, 32)) t(dataset_id, affine, n_rows, n_relations)",
    "affine_none": "select 3 as n_independent, 0 as n_relations",
    "affine_independents": "select * from (values (0, 'x'), (1, 'w'), (2, 'y')) t(ordinal, column_name)",
    "control_gates": "select unnest(['positive', 'null', 'metadata', 'framing', 'roundtrip', 'noise', 'sweep', 'composed', 'period', 'own_period']) as gate, true as passed",
    "xor_rows": "select l_returnflag, bit_xor(l_orderkey) as xor_order, bit_xor(l_partkey * 64 + l_linenumber) as xor_part, count(*) as n_rows from lineitem group by 1",
    "ledger_rollup": f"""with {_SIZE_SQL}, g as (select lang, source, raw_best - composed_best as gap from best join (select distinct lang, source, lang || '/' || source as dataset_id from documents) using (dataset_id))
select lang, source, count(*) as n_records, sum(gap)::bigint as total_gap_bytes, grouping(lang, source)::bigint as level from g group by rollup (lang, source)""",
    "gap_metrics": f"with {_SIZE_SQL} select dataset_id, raw_best as raw_best_bytes, composed_best as composed_best_bytes, raw_best - composed_best as gap_bytes, (raw_best - composed_best)::double / raw_best as gap_pct from best",
    "matched_gap": f"""with {_SIZE_SQL} select dataset_id, mgap as matched_gap_bytes, mgap::double / mraw as matched_gap_pct, s1.cs = s2.cs as codec_sets_match, array_to_string(s1.cs, ',') as available_raw_codecs from matched
join (select dataset_id, list_sort(list(codec)) as cs from ok where side = 'raw' group by 1) s1 using (dataset_id) join (select dataset_id, list_sort(list(codec)) as cs from ok where side = 'composed' group by 1) s2 using (dataset_id)""",
    "claims_abc": f"with {_SIZE_SQL} {_RESULTS} {_CLAIMS} select dataset_id, claim_a, claim_b, claim_c, mean0 and dataset_id != 'en/src0' as meaningful, mean0 and dataset_id != 'en/src0' and {_REPORTABLE} as reportable from me",
    "verdict": f"""with {_SIZE_SQL} {_RESULTS} {_CLAIMS}, t as (select *, case when rgap = 0 then 'raw_gap0' else 'raw_gap' || case when rgap > 0 then '+' else '' end || rgap end as a, case when gap = 0 then '' else case when gap > 0 then '+' else '' end || gap end as g from me)
select dataset_id, case when not crt then 'FAIL_COMPOSED_ROUNDTRIP ' else '' end || case when not rt then 'FAIL_ROUNDTRIP' when kind = 'PASSTHROUGH' or rels = 0 then a || ' no_deduction' || case when gap = 0 then '' else ' header_perturbation' || g end
when gap = 0 then a || ' comp_gap0' else a || ' comp_gap' || g end as verdict from t""",
    "outcome": f"with {_SIZE_SQL} {_RESULTS} {_CLAIMS} select count(*) as n_datasets, count(*) filter (where mean0) as n_meaningful, true as valid, case when bool_or(mean0 and {_REPORTABLE}) then 'POSITIVE' else 'NEGATIVE' end as outcome from me",
    "companion_metrics": f"""with {_SIZE_SQL} {_RESULTS} select dataset_id, 8.0::double * (dataset_bytes // 5 - enc) / dataset_bytes as bits_per_byte_gap, rec::double / (8 * dataset_bytes) as recovered_fraction,
(rels * 64)::double / greatest(rec, 1) as description_ratio, (rels * 64)::double / (8 * enc) as overhead_fraction from res""",
    "monotone_sweep": "with s as (select doc_id % 10 as phi, sum(n_chars)::bigint as gap_bytes from documents group by 1), p as (select *, lag(gap_bytes) over (order by phi) as previous from s) select phi, gap_bytes, previous, coalesce(gap_bytes <= previous + 2000, true) as passed from p",
    "offset_vs_phase0": """with d as (select source as dataset_id, sum(n_chars)::bigint % 2001 - 1000 as gap_bytes, max(n_chars) % 601 - 300 as phase0_gap_bytes from documents group by 1)
select *, gap_bytes - phase0_gap_bytes > 64 as helped, gap_bytes > 0 and phase0_gap_bytes <= 0 as crosses from d""",
    "manifest_pin": "select doc_id::varchar as dataset_id, sha256(text) as sha256, octet_length(encode(text)) as n_bytes from documents",
    "ledger_flatten": f"""with {_SIZE_SQL} select d.dataset_id as experiment_id, n // 2 + 40 as baseline_one, case when m > 2 then n // 3 + m * 90 end as baseline_two, n // 2 - 7 * m as composed_one, n // 4 + m as composed_three,
raw_best - composed_best as gap_bytes, raw_best - m as raw_gap_bytes, m + 283 as metadata_bits, m % 2 = 0 as accounting_ok, 'not-checked' as composed_state from d join best using (dataset_id)""",
    "ledger_summary": f"with {_SIZE_SQL} select count(*) as n_records, 0::bigint as n_roundtrip_failures, count(*) filter (where m % 2 = 1) as n_accounting_failures, 0::bigint as n_composed_failures, count(*) as n_composed_not_checked from d",
    "ledger_report": f"with {_SIZE_SQL} select d.dataset_id as experiment_id, m::int as n_relations, raw_best - composed_best as gap_bytes from d join best using (dataset_id)",
    "check_claims": f"""with {_SIZE_SQL} select i as line_no, d.dataset_id as experiment_id, f as field, ok from d, (values (0, 'gap_bytes', true), (1, 'large', false), (2, 'gap_pct', true), (3, 'gap_pct', false), (4, 'codec_kind', true),
(5, 'codec_kind', false), (6, 'roundtrip_ok', true), (7, 'roundtrip_ok', false), (8, 'no_such_field', false), (9, 'verdict', true)) v(i, f, ok)""",
}
