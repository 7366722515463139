"""Readers of data as bytes or tables, and the manifest that pins their checksums."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, prefix_bytes: int | None = None, category: str | None = None, glob: str | None = None) -> DataFrame:
    """Files as datasets (dataset_id = file name, bytes, n_bytes, sha256, category); ``prefix_bytes`` keeps the start of each."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    data = F.substring("content", 1, prefix_bytes) if prefix_bytes else F.col("content")
    return described(files.select(F.element_at(F.split("path", "/"), -1).alias("dataset_id"), data.alias("bytes")), category)


def described(datasets: DataFrame, category: str | None = None) -> DataFrame:
    return datasets.select("dataset_id", "bytes", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"), F.lit(category).cast("string").alias("category"))


def read_archive_members(spark: SparkSession, path: str, suffix: str | None = None, largest_only: bool = False, prefix_bytes: int | None = None) -> DataFrame:
    """Members of .zip and .tar(.gz) files as datasets named archive/member; an archive is read in one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def members(name: str, data: bytes):
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                yield from ((m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile())

    def run(batches):
        for b in batches:
            for name, data in zip(b["name"], b["content"], strict=True):
                got = [(m, x) for m, x in members(name, data) if not suffix or m.endswith(suffix)]
                if largest_only and got:
                    got = [max(got, key=lambda g: (len(g[1]), g[0]))]
                yield pd.DataFrame({"dataset_id": [f"{name}/{m}" for m, _ in got], "bytes": [x[:prefix_bytes] if prefix_bytes else x for _, x in got]})

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return described(named.mapInPandas(run, "dataset_id string, bytes binary"))


def read_int_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header as LONG columns; a value that is no whole number fails the read."""
    schema = ", ".join(f"`{c}` long" for c in columns)
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=True)


def read_measurements(spark: SparkSession, path: str, names: list[str], sep: str = ";", missing: str = "?") -> DataFrame:
    """Delimited text whose missing values are marked: rows with one are dropped, the named columns are doubles."""
    raw = spark.read.csv(path, header=True, sep=sep, nullValue=missing)
    return raw.select(*[F.col(n).cast("double").alias(n) for n in names]).dropna()


def int_columns(df: DataFrame, columns: list[str], cents: list[str] | None = None) -> DataFrame:
    """LONG columns for relation discovery; those in ``cents`` are money, times 100 and rounded."""
    return df.select(*[(F.round(F.col(c) * 100) if c in (cents or []) else F.col(c)).cast("long").alias(c) for c in columns])


def pin_or_verify(datasets: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """The manifest (dataset_id, sha256, n_bytes) with new datasets added; raises where a pinned checksum differs."""
    seen = datasets.select("dataset_id", F.sha2("bytes", 256).alias("sha256"), F.octet_length("bytes").cast("long").alias("n_bytes"))
    if manifest is None:
        return seen
    changed = seen.join(manifest.select("dataset_id", F.col("sha256").alias("pinned")), "dataset_id").where("sha256 != pinned").limit(5).collect()
    if changed:
        raise ValueError(f"checksums differ from the manifest: {[r['dataset_id'] for r in changed]}")
    return manifest.unionByName(seen.join(manifest, "dataset_id", "left_anti"))
