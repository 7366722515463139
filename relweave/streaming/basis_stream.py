"""Column bases over streams: echelon states are bounded and mergeable, so each micro-batch folds into one stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from relweave.functions.container import configurations
from relweave.operators import bases


class BasisStream:
    """``foreachBatch`` sink for (dataset_id, bytes) rows, each a whole number of records of every width.

    The state lies under ``path``, one generation a batch; a batch that is delivered twice is folded in once.
    """

    def __init__(self, path: str, configs: list[tuple[int, int, bool]] | None = None):
        self.path, self.configs = path, configs or configurations()

    def _last(self, spark) -> tuple[int, DataFrame | None]:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return -1, None
        done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(hadoop) if "=" in s.getPath().getName() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return (max(done), spark.read.parquet(f"{self.path}/generation={max(done)}")) if done else (-1, None)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at, state = self._last(spark)
        if batch_id <= at:
            return
        new = bases.partial_states(bases.chunked(batch), self.configs)
        merged = bases.merge_states(new if state is None else new.unionByName(state))
        merged.write.mode("overwrite").parquet(f"{self.path}/generation={batch_id}")

    def bases(self, spark) -> DataFrame:
        """The bases of everything seen so far."""
        _, state = self._last(spark)
        if state is None:
            raise ValueError("no batch has been folded in yet")
        return bases.merge_states_to_bases(state)
