"""Gaps, claims, verdicts and gates over a table of codec sizes: DataFrames in, DataFrames out.

``sizes``: (dataset_id, side raw|composed, codec, bytes, available). ``results``: (dataset_id, dataset_bytes,
codec_kind, n_relations, recovered_bits, total_encoded_bytes, roundtrip_ok, composed_roundtrip_ok).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relweave.functions.container import OVERHEAD

#: Thresholds of a meaningful result.
LEAST_PCT, LEAST_BYTES = 0.05, 1024
#: What counts as no more than header noise.
NOISE_BYTES = 64


def gaps(sizes: DataFrame) -> DataFrame:
    """Best raw and composed sizes, the composition gap, and the gap over the codecs that both sides have."""
    ok = sizes.where("available")
    best = ok.groupBy("dataset_id").agg(
        F.min(F.when(F.col("side") == "raw", F.col("bytes"))).alias("raw_best_bytes"),
        F.min(F.when(F.col("side") == "composed", F.col("bytes"))).alias("composed_best_bytes"),
        F.array_sort(F.collect_set(F.when(F.col("side") == "raw", F.col("codec")))).alias("raw_codecs"),
        F.array_sort(F.collect_set(F.when(F.col("side") == "composed", F.col("codec")))).alias("composed_codecs"),
    )
    raw, composed = (ok.where(F.col("side") == s).select("dataset_id", "codec", F.col("bytes").alias(s)) for s in ("raw", "composed"))
    matched = raw.join(composed, ["dataset_id", "codec"]).groupBy("dataset_id").agg((F.min("raw") - F.min("composed")).alias("matched_gap_bytes"), F.min("raw").alias("matched_raw"))
    out = best.join(matched, "dataset_id", "left")
    gap = F.col("raw_best_bytes") - F.col("composed_best_bytes")
    return out.select(
        "dataset_id", "raw_best_bytes", "composed_best_bytes", gap.alias("gap_bytes"), F.try_divide(gap.cast("double"), "raw_best_bytes").alias("gap_pct"),
        "matched_gap_bytes", F.try_divide(F.col("matched_gap_bytes").cast("double"), "matched_raw").alias("matched_gap_pct"),
        (F.col("raw_codecs") == F.col("composed_codecs")).alias("codec_sets_match"), F.concat_ws(",", "raw_codecs").alias("available_raw_codecs"), F.concat_ws(",", "composed_codecs").alias("available_composed_codecs"),
    )


def with_claims(results: DataFrame, gap: DataFrame, prior_art: list[str] | None = None) -> DataFrame:
    """Claims A (discoverable), B (reduces), C (survives composition), meaningful and reportable."""
    r = results.join(gap, "dataset_id", "left").withColumn("raw_gap_bytes", F.col("raw_best_bytes") - F.col("total_encoded_bytes"))
    no = F.lit(False)
    passthrough = (F.col("codec_kind") == "PASSTHROUGH") | (F.col("n_relations") == 0)
    claim_c = F.coalesce(F.col("gap_bytes") > 0, no)
    known = F.col("dataset_id").isin(prior_art) if prior_art else no
    enough = lambda pct, n: F.coalesce((F.col(pct) >= LEAST_PCT) & (F.col(n) >= LEAST_BYTES), no)
    meaningful = claim_c & enough("gap_pct", "gap_bytes") & F.col("roundtrip_ok") & ~passthrough & ~known & (F.col("recovered_bits") >= 1)
    reportable = meaningful & F.coalesce("composed_roundtrip_ok", no) & (F.coalesce("codec_sets_match", no) | enough("matched_gap_pct", "matched_gap_bytes"))
    claim_b = (F.col("total_encoded_bytes") < F.col("dataset_bytes") + OVERHEAD) & F.coalesce(F.col("raw_gap_bytes") > 0, no)
    return r.withColumns({"claim_a": F.col("n_relations") >= 1, "claim_b": claim_b, "claim_c": claim_c, "meaningful": meaningful, "reportable": reportable})


def with_companions(results: DataFrame) -> DataFrame:
    """bits_per_byte_gap, recovered_fraction, description_ratio and overhead_fraction (null where the divisor is 0)."""
    return results.withColumns({
        "bits_per_byte_gap": F.try_divide(8.0 * F.col("raw_gap_bytes"), F.col("dataset_bytes")),
        "recovered_fraction": F.try_divide(F.col("recovered_bits").cast("double"), 8 * F.col("dataset_bytes")),
        "description_ratio": F.col("relation_bits") / F.greatest(F.col("recovered_bits"), F.lit(1)),
        "overhead_fraction": F.try_divide(F.col("relation_bits").cast("double"), F.col("total_bits")),
    })


def with_verdict(results: DataFrame) -> DataFrame:
    """The verdict line from roundtrip_ok, raw_gap_bytes, gap_bytes, codec_kind, n_relations and the composed check."""
    signed = lambda c: F.concat(F.when(F.col(c) >= 0, "+").otherwise(""), F.col(c).cast("string"))
    raw = F.when(F.col("raw_gap_bytes").isNull(), "no_baseline").when(F.col("raw_gap_bytes") == 0, "raw_gap0").otherwise(F.concat(F.lit("raw_gap"), signed("raw_gap_bytes")))
    none = (F.col("codec_kind") == "PASSTHROUGH") | (F.col("n_relations") == 0)
    noise = F.when(F.col("gap_bytes") != 0, F.concat(F.lit("header_perturbation"), signed("gap_bytes")))
    composed = F.when(F.col("gap_bytes").isNull(), "no_composition").when(F.col("gap_bytes") == 0, "comp_gap0").otherwise(F.concat(F.lit("comp_gap"), signed("gap_bytes")))
    line = F.when(none, F.concat_ws(" ", raw, F.lit("no_deduction"), noise)).otherwise(F.concat_ws(" ", raw, composed))
    line = F.when(F.col("roundtrip_ok"), line).otherwise("FAIL_ROUNDTRIP")
    failed = F.coalesce(F.col("composed_roundtrip_ok") == False, F.lit(False))  # noqa: E712
    return results.withColumn("verdict", F.when(failed, F.concat(F.lit("FAIL_COMPOSED_ROUNDTRIP "), line)).otherwise(line))


def outcome(claims: DataFrame, gates: DataFrame) -> DataFrame:
    """POSITIVE, NEGATIVE or INCONCLUSIVE: one row. ``gates``: (gate, passed)."""
    g = gates.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("valid"))
    c = claims.agg(F.coalesce(F.bool_or("reportable"), F.lit(False)).alias("any"), F.count("*").alias("n_datasets"), F.count_if("meaningful").alias("n_meaningful"))
    return c.join(g).select("n_datasets", "n_meaningful", "valid", F.when(~F.col("valid") | (F.col("n_datasets") == 0), "INCONCLUSIVE").when(F.col("any"), "POSITIVE").otherwise("NEGATIVE").alias("outcome"))


def monotone_sweep(sweep: DataFrame, by: str = "phi", gap: str = "gap_bytes", slack: int = NOISE_BYTES) -> DataFrame:
    """Each step of a degradation sweep against the one before: the gap may not rise by more than ``slack``. One row a step."""
    before = F.lag(gap).over(Window.orderBy(by))
    return sweep.withColumn("previous", before).withColumn("passed", F.coalesce(F.col(gap) <= F.col("previous") + slack, F.lit(True)))


#: Gates over any set of control results, and those of controls made for one purpose.
GATES = ("positive", "null", "metadata", "framing", "roundtrip")
MORE_GATES = ("noise", "sweep", "composed", "period", "own_period")
#: Noise inputs that the gate ``noise`` needs at least.
NOISE_INPUTS = 40


def control_gates(results: DataFrame, gates: tuple[str, ...] = GATES) -> DataFrame:
    """(gate, passed) over control results, whose column ``control`` says what each is for. A gate without any result fails.

    positive: a large gap; null: none beyond noise, in passthrough; metadata and framing: sizes add up; roundtrip: all
    decode; noise: at least NOISE_INPUTS inputs without structure, none with a relation; sweep: gaps never below noise, nor
    rising with ``phi``; composed: decompressed containers decode; period: a record length that is not searched is missed;
    own_period: searched, it is found.
    """
    is_ = lambda name: F.col("control") == name
    rule = {
        "positive": (is_("positive"), F.col("gap_pct") >= 0.30),
        "null": (is_("null"), (F.abs("gap_bytes") <= NOISE_BYTES) & (F.col("codec_kind") == "PASSTHROUGH")),
        "metadata": (F.col("codec_kind") == "PASSTHROUGH", F.col("total_encoded_bytes") == F.col("dataset_bytes") + OVERHEAD),
        "framing": (F.lit(True), F.col("framing_bits").between(0, 7) & (F.col("total_bits") == 8 * F.col("total_encoded_bytes"))),
        "roundtrip": (F.lit(True), F.col("roundtrip_ok")),
    }
    if set(gates) & set(MORE_GATES):
        rule |= {
            "noise": (is_("noise"), (F.col("codec_kind") == "PASSTHROUGH") & (F.col("n_relations") == 0)),
            "sweep": (is_("sweep"), F.col("gap_bytes") >= -NOISE_BYTES),
            "composed": (is_("composed"), F.col("composed_roundtrip_ok")),
            "period": (is_("period"), (F.col("codec_kind") == "PASSTHROUGH") & F.col("roundtrip_ok")),
            "own_period": (is_("own_period"), (F.col("codec_kind") == "GF2") & (F.col("n_relations") >= 1) & F.col("roundtrip_ok")),
        }
    rule = {g: rule[g] for g in gates}
    least = {"noise": NOISE_INPUTS, "sweep": 2}
    one = results.agg(*[(F.bool_and(F.when(on, F.coalesce(ok, F.lit(False)))) & (F.count_if(on) >= least.get(g, 1))).alias(g) for g, (on, ok) in rule.items()])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.coalesce(g, F.lit(False)).alias("passed")) for g in rule])).alias("g")).select("g.*")
    if "sweep" in gates:
        steps = monotone_sweep(results.where(is_("sweep"))).agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("falling"))
        out = out.join(F.broadcast(steps)).select("gate", (F.col("passed") & ((F.col("gate") != "sweep") | F.col("falling"))).alias("passed"))
    return out


def against_phase_zero(offset_rows: DataFrame, zero_rows: DataFrame) -> DataFrame:
    """Offset results beside the same dataset's phase-0 gap (or its ``@slice`` form's): helped beyond noise, crosses zero."""
    zero = zero_rows.select(F.col("dataset_id").alias("zero_id"), F.col("gap_bytes").alias("zero_gap"))
    a, b = zero.select(F.col("zero_id").alias("dataset_id"), F.col("zero_gap").alias("exact")), zero.select(F.regexp_replace("zero_id", "@slice$", "").alias("dataset_id"), F.col("zero_gap").alias("sliced")).where(F.col("zero_id").endswith("@slice"))
    out = offset_rows.join(a, "dataset_id", "left").join(b, "dataset_id", "left").withColumn("phase0_gap_bytes", F.coalesce("exact", "sliced")).drop("exact", "sliced")
    return out.withColumns({"helped": F.coalesce(F.col("gap_bytes") - F.col("phase0_gap_bytes") > NOISE_BYTES, F.lit(False)), "crosses": F.coalesce((F.col("gap_bytes") > 0) & (F.col("phase0_gap_bytes") <= 0), F.lit(False))})


def pivots_alone(containers: DataFrame, pivot_sizes: DataFrame) -> DataFrame:
    """What compressing the packed payload alone would give: best payload size plus the metadata's bytes."""
    best = pivot_sizes.where("available").groupBy("dataset_id").agg(F.min("bytes").alias("payload_best_bytes"))
    c = containers.select("dataset_id", F.ceil((8 * F.octet_length("bytes") - F.col("account.payload_bits")) / 8).alias("metadata_bytes"))
    return c.join(best, "dataset_id").withColumn("packed_total_bytes", F.col("metadata_bytes") + F.col("payload_best_bytes"))
