"""Session helpers: shared scratch folder, lineage cuts, partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see, from ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) a folder on this machine is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.gettempdir() + "/checkpoints"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lineage cut that survives lost executors.

    The files go when the Spark driver ends (or earlier, with ``release``). Spark deletes a shuffle's files only when the
    driver collects its garbage, so that is asked for here: jobs of many steps then need the disk of a few steps.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/relweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    jvm.System.gc()  # shuffles of what has been written are garbage now: Spark deletes their files once it knows
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._relweave_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete the files of a DataFrame made by ``materialize`` once nothing reads them any more."""
    path = getattr(df, "_relweave_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
