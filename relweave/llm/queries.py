"""The ``opN_<name>`` queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from relweave.llm.sentencepiece_codec import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relweave.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def _fold(key, folds: int):
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(folds))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relweave.llm.url_filters import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relweave.llm import quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), lambda k: _fold(k, 5) != 0)
    scored = quality.score_documents(docs, model, keep=["doc_id"])
    held_out = F.coalesce(_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relweave.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relweave.llm.sharding import shard_by_bytes

    return shard_by_bytes(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relweave.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relweave.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), lambda k: _fold(k, 3) != 1)
    scored = toxicity.score_documents(docs, model, keep=["doc_id"])
    held_out = F.coalesce(_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relweave.llm.epsilon_grid import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relweave.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_quality": op2_quality,
    "op3_fingerprints": op3_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_epsilon_grid": op5_epsilon_grid,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_sharding": op9_sharding,
    "op10_jaccard_join": op10_jaccard_join,
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op5_epsilon_grid": """
with recursive good as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0),
link as (select a.vec_id as a, b.vec_id as b from good a, good b where a.vec_id != b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(node, seen) as (select vec_id, vec_id from embeddings union select r.node, l.b from reach r join link l on l.a = r.seen),
part as (select node, min(seen) as component_id from reach group by node)
select p.node as vec_id, (select count(*) from link where a = p.node) as n_links, p.component_id, p.node = p.component_id as kept from part p
""",
    "op1_url_filters": f"""
with rules(h, p, a) as (values {_RULES_SQL}),
cut as (select page_id, row_number() over () as rn, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
parts as (select page_id, rn, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
fit as (select rn, max_by(h || p, (length(h) + length(p)) * 10000 + length(h)) as rule, max_by(a, (length(h) + length(p)) * 10000 + length(h)) as verdict
        from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rn)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fit using (rn)
""",
}
