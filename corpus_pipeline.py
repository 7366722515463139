"""A training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet into the
shared folder and reads them again for the next. All stages but the last return the columns of documents.

1. quality: documents that the Bradley-Terry classifier scores below its threshold go.
2. line_dedup: lines that match an earlier line go from the texts.
3. near_duplicates: of each group of linked documents (five-word shingles, Jaccard 0.8 or more) the one with the
   smallest id stays.
4. mixing: a document is repeated as often as the mix takes its words (to a whole number by a seeded hash); with 0 it goes.
5. encode: number and digest of each text's SentencePiece ids, and the digest of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import quality
from relweave.llm.jaccard_join import jaccard_components
from relweave.llm.line_dedup import dedup_lines
from relweave.llm.mixing import mix_sources
from relweave.llm.names import unused
from relweave.llm.sentencepiece_codec import token_digests
from relweave.runtime import materialize, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # one label in five is held out, as in op2_quality
    learn = lambda key: F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(5)) != 0
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn)
    (score,) = unused(docs, "score")
    scored = quality.score_documents(docs, model, out=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = jaccard_components(docs)
    kept = linked.where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept"]), "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the mix carries two hashes of each row, never its text; nulls are hashed apart, since a hash skips them
    row, again, chance = unused(docs, "row", "again", "chance")
    held = [*docs.columns, *[F.col(c).isNull() for c in docs.columns]]
    keyed = docs.select(*docs.columns, F.xxhash64(*held).alias(row), F.xxhash64(F.lit(29), *held).alias(again))
    # whole documents: the share of a text that the mix takes, rounded up or down by a seeded hash
    seeded = F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    mixed = mix_sources(keyed.select("doc_id", "text", "source", row, again, seeded.alias(chance)), keep=[row, again, chance])
    copies = F.when(F.col("taken") > 0, F.floor(F.col("taken") / F.col("size") + F.col(chance))).otherwise(0).cast("int")
    # rows that are equal throughout are one here, repeated as often as all of them together
    counts = mixed.groupBy(row, again).agg(F.sum(copies).cast("int").alias(chance), F.count("*").alias("rows"))
    counts = materialize(counts, "mix")
    if not counts.where("rows > 1").isEmpty():
        keyed = keyed.dropDuplicates([row, again])
    met = keyed.join(counts.where(F.col(chance) > 0).drop("rows"), [row, again])
    return met.select(*docs.columns, F.explode(F.sequence(F.lit(1), chance)).alias(chance)).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("encode", encode_stage),
]

#: A learned score and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
