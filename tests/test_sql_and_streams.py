from relweave import sql
from relweave.functions import gf2
from relweave.functions.bits import reshape
from relweave.sources import generators as G
from relweave.streaming.basis_stream import BasisStream


def test_sql_functions(spark):
    sql.register(spark)
    d = G.crc_records(64, 3)
    G.to_frame(spark, [d]).createOrReplaceTempView("sets")
    r = spark.sql("select dedc_decode(dedc_encode_best(bytes)) = bytes as same, length(dedc_encode(bytes, 64, true)) < length(bytes) + 18 as smaller from sets").first()
    assert r["same"] and r["smaller"]
    rows = spark.sql("select r.* from sets, lateral gf2_relations(bytes, 64, true) r").collect()
    assert len(rows) == gf2.affine_column_basis(reshape(d.data, 64)[0]).n_relations
    assert spark.sql("select gf2_parity(array(7L, 1L), array(3L, 1L)) as p").first()["p"] == 1
    assert spark.sql("select crc32_le(cast('abc' as binary)) = substring(cast('xx' as binary), 1, 0) as p").first()["p"] is False
    import zlib

    assert bytes(spark.sql("select crc32_le(cast('abc' as binary)) as c").first()["c"]) == zlib.crc32(b"abc").to_bytes(4, "little")


def test_stream_equals_batch(spark, tmp_path):
    d = G.gf2_linear_code(512, 12, 12, 5)
    parts = [d.data[i : i + 384] for i in range(0, len(d.data), 384)]
    (tmp_path / "in").mkdir()
    frame = spark.createDataFrame([("code", bytearray(p)) for p in parts], "dataset_id string, bytes binary")
    frame.repartition(4).write.parquet(f"{tmp_path}/in/data")
    sink = BasisStream(f"{tmp_path}/state", [(24, 0, False), (24, 0, True)])
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/data")
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sink.bases(spark).where("not affine").first()
    want = gf2.column_basis(reshape(d.data, 24)[0])
    assert (got["pivots"], got["free"], got["n_rows"]) == (want.pivots, want.free, want.n_rows)
    sink(frame, 0)
    assert sink.bases(spark).where("not affine").first()["n_rows"] == want.n_rows
