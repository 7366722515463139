"""Names for use in spark.sql: functions, a table function and views over a directory of tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from relweave.functions import container as C
from relweave.functions.bits import reshape
from relweave.functions.gf2 import affine_column_basis, column_basis


def register(spark: SparkSession) -> None:
    """gf2_parity(words, mask) and crc32_le(bytes) in SQL itself; dedc_encode, dedc_encode_best and dedc_decode; gf2_relations as a table function."""
    spark.sql("create or replace temporary function gf2_parity(words array<bigint>, mask array<bigint>) returns int return aggregate(zip_with(words, mask, (w, m) -> bit_count(w & m)), 0, (a, b) -> a + b) % 2")
    spark.sql("create or replace temporary function crc32_le(b binary) returns binary return unhex(concat(substring(lpad(hex(crc32(b)), 8, '0'), 7, 2), substring(lpad(hex(crc32(b)), 8, '0'), 5, 2), substring(lpad(hex(crc32(b)), 8, '0'), 3, 2), substring(lpad(hex(crc32(b)), 8, '0'), 1, 2)))")

    def each(f):
        return lambda s: pd.Series([None if x is None else f(bytes(x)) for x in s], dtype=object)

    @F.pandas_udf("binary")
    def dedc_encode_best(data: pd.Series) -> pd.Series:
        return each(lambda x: C.encode_best(x).data)(data)

    @F.pandas_udf("binary")
    def dedc_decode(data: pd.Series) -> pd.Series:
        return each(C.decode)(data)

    @F.pandas_udf("binary")
    def dedc_encode(data: pd.Series, width: pd.Series, affine: pd.Series) -> pd.Series:
        return pd.Series([C.encode_gf2(bytes(x), int(w), bool(a)).data for x, w, a in zip(data, width, affine, strict=True)], dtype=object)

    class GF2Relations:
        def eval(self, data: bytes, width: int, affine: bool):
            matrix, _, _ = reshape(bytes(data), width)
            if len(matrix):
                basis = affine_column_basis(matrix) if affine else column_basis(matrix)
                for f, row, const in zip(basis.free, basis.coefficients, basis.const, strict=True):
                    yield f, [p for p, k in zip(basis.pivots, row, strict=True) if k], bool(const)

    spark.udf.register("dedc_encode_best", dedc_encode_best)
    spark.udf.register("dedc_decode", dedc_decode)
    spark.udf.register("dedc_encode", dedc_encode)
    spark.udtf.register("gf2_relations", F.udtf(GF2Relations, returnType="free_col int, pivot_cols array<int>, const boolean"))


def create_views(spark: SparkSession, directory: str, tables: list[str]) -> None:
    for t in tables:
        spark.read.parquet(f"{directory}/{t}.parquet").createOrReplaceTempView(t)
