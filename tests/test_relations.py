"""Distributed discovery, containers and ledger on small DataFrames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relweave.functions import container as C
from relweave.functions import gf2
from relweave.functions.bits import reshape
from relweave.operators import affine, bases, codec_sizes, containers, functional, ledger, metrics
from relweave.operators.affine import AffineRelation
from relweave.sources import generators as G
from relweave.sources import readers


def table(spark, columns, parts=3):
    names = list(columns)
    rows = list(zip(*[[int(v) for v in columns[n]] for n in names], strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names)).repartition(parts)


def test_univariate(spark):
    x = np.arange(20)
    left, found = affine.discover_affine(table(spark, {"x": x, "y": 7 * x - 3}), ["x", "y"])
    assert left == ["x"] and found == [AffineRelation("y", "x", None, 7, 0, -3)]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_bivariate_in_any_column_order_and_partitioning(spark, parts):
    rng = np.random.default_rng(1)
    x, y = rng.integers(-1000, 1000, 80), rng.integers(-1000, 1000, 80)
    df = table(spark, {"x": x, "y": y, "z": 2 * x + 3 * y + 5}, parts)
    for order in (["x", "y", "z"], ["z", "y", "x"], ["y", "z", "x"]):
        left, found = affine.discover_affine(df, order)
        assert len(left) == 2 and len(found) == 1
        assert not affine.count_violations(df, found)[found[0]]
    assert affine.discover_affine(df, ["x", "y", "z"])[1] == [AffineRelation("z", "x", "y", 2, 3, 5)]


def test_near_relations_and_extremes(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(-50, 50, 60), rng.integers(-50, 50, 60)
    z = 4 * x - y + 11
    z[17] += 1
    assert affine.discover_affine(table(spark, {"x": x, "y": y, "z": z}), ["x", "y", "z"])[1] == []
    big = [2**62, -(2**62), 2**62 - 1, 0, 5]
    left, found = affine.discover_affine(table(spark, {"x": big, "z": [v // 1 + 1 for v in big]}), ["x", "z"])
    assert found == [AffineRelation("z", "x", None, 1, 0, 1)]
    wide = AffineRelation("z", "x", "y", 2**70, -(2**70), 0)
    same = table(spark, {"x": [5, 2**62], "y": [5, 2**62], "z": [0, 0]})
    assert affine.count_violations(same, [wide])[wide] == 0
    assert affine.discover_affine(table(spark, {"x": [3], "y": [4]}), ["x", "y"])[0] == ["x"]
    assert affine.discover_affine(table(spark, {"x": [], "y": []}), ["x", "y"]) == (["x", "y"], [])
    with pytest.raises(ValueError):
        affine.discover_affine(spark.createDataFrame([(1, None)], "x long, y long"), ["x", "y"])


def test_constant_and_two_point_columns(spark):
    s = affine.AffineSearch(table(spark, {"x": [1, 1, 2, 2], "y": [5, 5, 9, 9], "k": [4, 4, 4, 4]}), ["x", "y", "k"])
    assert s.uni["k", "x"] == AffineRelation("k", "x", None, 0, 0, 4)
    assert s.bivariate("k", "x", "y") == AffineRelation("k", "x", "y", 0, 0, 4)
    collinear = affine.AffineSearch(table(spark, {"x": [1, 2, 3, 4], "y": [2, 4, 6, 8], "z": [0, 1, 5, 2]}), ["x", "y", "z"])
    assert collinear.bivariate("z", "x", "y") is None


def test_apply(spark):
    rel = [AffineRelation("u", "z", "x", 2, 1, 0), AffineRelation("z", "x", "y", 3, 5, 7)]
    got = affine.apply_relations(table(spark, {"x": [1], "y": [2]}), rel).first()
    assert (got["z"], got["u"]) == (20, 41)
    with pytest.raises(ValueError):
        affine.apply_relations(table(spark, {"x": [1]}), [AffineRelation("a", "b", None, 1, 0, 0), AffineRelation("b", "a", None, 1, 0, 0)])


def test_functional(spark):
    good, bad = table(spark, {"a": [1, 4, 10], "b": [2, 5, 20], "c": [3, 9, 30]}), table(spark, {"a": [1, 1], "b": [2, 2], "c": [3, 4]})
    assert functional.is_function_of(good, "c", ["a", "b"]) and not functional.is_function_of(bad, "c", ["a", "b"])
    assert functional.lookup_table(bad, "c", ["a", "b"]) is None and functional.lookup_table(good, "c", ["a", "b"]).count() == 3
    assert functional.mapping_cost_bits(3, 8, [4, 4]) == 80
    a, b = np.arange(40) % 4, np.arange(40) // 4 % 3
    deps = functional.discover_maps(table(spark, {"a": a, "b": b, "c": a * 10 + b, "d": a * a}), ["a", "b", "c", "d"])
    assert [(d.z, d.sources, d.n_entries) for d in deps] == [("c", ("a", "b"), 12), ("d", ("a",), 4)]


@pytest.mark.parametrize("chunk", [64, 1000, 1 << 20])
def test_distributed_bases_equal_local_ones(spark, chunk):
    sets = [G.gf2_linear_code(300, 12, 12, 5), G.Dataset("shifted", b"\x5a" + G.gf2_linear_code(200, 12, 12, 6).data), G.Dataset("tiny", b"ab"), G.Dataset("none", b"")]
    configs = [(w, o, a) for w, o in ((24, 0), (24, 8), (17, 3), (64, 0), (256, 0)) for a in (False, True)]
    df = G.to_frame(spark, sets).select("dataset_id", "bytes")
    got = {(r["dataset_id"], r["width"], r["offset"], r["affine"]): r for r in bases.bases(df, configs, chunk).collect()}
    for d in sets:
        for w, o, a in configs:
            m, _, _ = reshape(d.data, w, o)
            if not len(m):
                r = got.get((d.dataset_id, w, o, a))
                assert r is None or (r["n_rows"], r["n_relations"]) == (0, 0)
                continue
            want = gf2.affine_column_basis(m) if a else gf2.column_basis(m)
            r = got[d.dataset_id, w, o, a]
            assert (r["n_rows"], r["pivots"], r["free"]) == (len(m), want.pivots, want.free)
            assert r["masks"] == [x.astype(np.int64).tolist() for x in want.masks()] and r["const"] == [bool(c) for c in want.const]


def test_verify_and_rebuild(spark):
    d = G.gf2_linear_code(200, 70, 20, 4)
    m, _, _ = reshape(d.data, 90)
    from relweave.functions.bits import pack_rows

    rows = spark.createDataFrame([(r.astype(np.int64).tolist(),) for r in pack_rows(m)], "words array<bigint>")
    b = bases.column_basis(rows, 90).where("not affine").first()
    back = bases.rebuilt(F.col("words"), b["pivots"], b["free"], b["masks"], b["const"], 90)
    assert rows.where(back != F.col("words")).count() == 0
    assert all(r["n_violations"] == 0 for r in bases.violations(rows, list(zip(b["masks"], b["const"], strict=True))).collect())
    assert bases.edges(bases.column_basis(rows, 90)).where("not affine").count() == int(gf2.column_basis(m).coefficients.sum())


def test_best_containers(spark):
    sets = [G.gf2_linear_code(1280, 32, 32, 902), G.near_relation_bits(512, 15, 1), G.crc_records(512, 3), G.Dataset("empty", b"")]
    df = G.to_frame(spark, sets).select("dataset_id", "bytes")
    made = {r["dataset_id"]: r for r in containers.encode_best(df).collect()}
    sizes = {r["dataset_id"]: r for r in containers.best_configurations(df).collect()}
    for d in sets:
        want = C.encode_best(d.data)
        assert bytes(made[d.dataset_id]["bytes"]) == want.data and sizes[d.dataset_id]["container_bytes"] == len(want.data)
    plain = {r["dataset_id"]: bytes(r["bytes"]) for r in containers.encode_passthrough(df).collect()}
    assert all(plain[d.dataset_id] == C.encode_passthrough(d.data).data for d in sets)
    ok = containers.round_trips(df, containers.encode_best(df)).collect()
    assert len(ok) == 4 and all(r["roundtrip_ok"] and r["accounting_ok"] and r["framing_ok"] for r in ok)


def test_phase_is_found(spark):
    d = G.Dataset("shifted", b"\x5a" + G.gf2_linear_code(2000, 12, 12, 6).data)
    best = containers.best_configurations(G.to_frame(spark, [d]).select("dataset_id", "bytes"), C.configurations((24,), {24: list(range(24))})).first()
    assert (best["kind"], best["offset"]) == ("GF2", 8)


def test_table_container(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 1000, 100), rng.integers(0, 1000, 100)
    df = table(spark, {"id": np.arange(100), "x": x, "y": y, "z": x + y})
    made = containers.encode_table(df, ["x", "y", "z"], "id")
    assert made.first()["kind"] == "TABULAR_AFFINE"
    back = containers.decode_table(made, ["x", "y", "z"]).orderBy("row_id").collect()
    assert [(r["x"], r["y"], r["z"]) for r in back] == [(int(a), int(b), int(a + b)) for a, b in zip(x, y, strict=True)]


def test_table_container_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(containers, "BLOCK_ROWS", 30)
    x, y = np.arange(100) * 7 % 50, np.arange(100) * 3 % 11
    df = table(spark, {"id": np.arange(100), "x": x, "y": y, "z": x + 2 * y}).repartition(3, "y")
    made = containers.encode_table(df, ["x", "y", "z"], "id")
    assert sorted((r["first_row"], r["kind"]) for r in made.collect()) == [(i, "TABULAR_AFFINE") for i in (0, 30, 60, 90)]
    back = containers.decode_table(made, ["x", "y", "z"]).orderBy("row_id").collect()
    assert [(r["row_id"], r["x"], r["y"], r["z"]) for r in back] == [(i, int(a), int(b), int(a + 2 * b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]


def test_table_container_with_large_keys(spark, tmp_path):
    from relweave.plans.queries import QUERIES

    # a part key of more than 20 bits, and sums of more than 64 bits
    rows = sorted((o << 40, n, (1 << 21) - n, o % 7 + n) for o in range(1000) for n in (1, 2, 3))
    spark.createDataFrame(rows[::-1], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["table_container"](spark, str(tmp_path)).first()
    want = [sum(i * v for i, v in enumerate(c, 1)) for c in zip(*[(x, y, 3 * x + 5 * y + 7, w) for w, _, x, y in rows], strict=True)]
    assert want[-1] > 2**63 and [int(v) for v in got] == [len(rows), *want]


def test_harness_and_ledger(spark, tmp_path):
    df = G.to_frame(spark, [G.gf2_linear_code(4096, 32, 32, 12), G.mixed_noise_bits(512, 64, 1)]).select("dataset_id", "bytes")
    out = ledger.measure(df, "test").collect()
    code = next(r for r in out if r["codec_kind"] == "GF2")
    null = next(r for r in out if r["codec_kind"] == "PASSTHROUGH")
    assert code["total_encoded_bytes"] == 16555 and code["meaningful"] and code["reportable"] and code["verdict"].startswith("raw_gap+")
    assert not null["claim_a"] and abs(null["gap_bytes"]) <= 64 and "no_deduction" in null["verdict"]
    assert code["n_codecs_checked"] + code["n_codecs_errored"] == 6
    first = spark.createDataFrame([("a", 1)], "dataset_id string, gap_bytes int")
    ledger.append(first, f"{tmp_path}/l")
    ledger.append(first.withColumn("more", F.lit(2)), f"{tmp_path}/l")
    assert set(ledger.read_ledger(spark, f"{tmp_path}/l").columns) == {"dataset_id", "gap_bytes", "more"}


def test_gates_and_forms(spark):
    rows = [("positive", "GF2", 0.5, 5000, 100, 60, 3, 480, True), ("null", "PASSTHROUGH", 0.0, -18, 100, 118, 0, 944, True)]
    df = spark.createDataFrame(rows, "control string, codec_kind string, gap_pct double, gap_bytes long, dataset_bytes long, total_encoded_bytes long, framing_bits long, total_bits long, roundtrip_ok boolean")
    assert all(r["passed"] for r in metrics.control_gates(df).collect())
    broken = df.withColumn("framing_bits", F.lit(8))
    assert [r["gate"] for r in metrics.control_gates(broken).collect() if not r["passed"]] == ["framing"]
    forms = spark.createDataFrame([("a", 5), ("a@slice", 3), ("a@offset", 4)], "dataset_id string, gap_bytes long")
    assert ledger.by_form(forms).first().asDict() == {"base_id": "a", "whole": 5, "slice": 3, "offset": 4}


def test_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"abcdef")
    got = readers.read_files(spark, str(tmp_path / "in"), prefix_bytes=3).first()
    assert bytes(got["bytes"]) == b"abc" and got["n_bytes"] == 3
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("one.txt", "1" * 9), z.writestr("two.txt", "22")
    big = readers.read_archive_members(spark, str(tmp_path / "z.zip"), largest_only=True).first()
    assert big["dataset_id"] == "z.zip/one.txt" and big["n_bytes"] == 9
    (tmp_path / "t.csv").write_bytes(G.csv_sums(50, 6))
    found = affine.discover_affine(readers.read_int_csv(spark, str(tmp_path / "t.csv"), ["a", "b", "c"]), ["a", "b", "c"])[1]
    assert found == [AffineRelation("c", "a", "b", 1, 1, 0)]
    (tmp_path / "m.csv").write_text("when;v;w\nx;1.5;2\ny;?;3\n")
    assert readers.read_measurements(spark, str(tmp_path / "m.csv"), ["v", "w"]).count() == 1
    sets = G.to_frame(spark, [G.Dataset("a", b"1")]).select("dataset_id", "bytes")
    pinned = readers.pin_or_verify(sets, None)
    assert readers.pin_or_verify(sets, pinned).count() == 1
    with pytest.raises(ValueError):
        readers.pin_or_verify(G.to_frame(spark, [G.Dataset("a", b"2")]).select("dataset_id", "bytes"), pinned)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_codec_sizes(spark):
    df = G.to_frame(spark, [G.Dataset("a", b"a" * 1000)]).select("dataset_id", "bytes")
    rows = codec_sizes.codec_sizes(df).collect()
    assert len(rows) == 6 and all(r["bytes"] is None or r["bytes"] < 100 for r in rows)


def _large(spark):
    """A dataset of more than 4,000,000 bytes that compresses fast."""
    return G.to_frame(spark, [G.Dataset("large", bytes(range(250)) * 16_100)]).select("dataset_id", "bytes")


def test_large_containers_are_checked_under_every_codec(spark):
    df = _large(spark)
    got = codec_sizes.composed_roundtrips(containers.encode_passthrough(df), df).first()
    assert got["all_ok"] and got["n_codecs_checked"] + got["n_codecs_errored"] == 6 and got["n_codecs_checked"] >= 5


def test_harness_checks_large_containers_under_every_codec(spark):
    got = ledger.measure(_large(spark), "test", [(8, 0, False)]).first()
    assert got["composed_roundtrip_ok"] and got["n_codecs_checked"] + got["n_codecs_errored"] == 6 and got["n_codecs_checked"] >= 5


def test_groups_of_codecs_are_tasks_of_their_own(spark):
    df = G.to_frame(spark, [G.Dataset("a", b"ab" * 1000), G.Dataset("b", b"abc" * 9000)]).select("dataset_id", "bytes")
    made = codec_sizes.sizes_of_both(df, containers.encode_passthrough(df)).select("dataset_id", "side", "codec", F.spark_partition_id().alias("task"))
    tasks = {}
    for r in made.collect():
        tasks.setdefault(r["task"], set()).add((r["dataset_id"], r["side"], r["codec"]))
    assert sorted(len(t) for t in tasks.values()) == [1] * 12 + [3] * 4
    # those that take longest first
    assert {(d, s) for d, s, _ in tasks[0]} == {("b", "composed")} and {d for d, _, _ in tasks[max(tasks)]} == {"a"}


def _few_documents(spark, path):
    rows = [(i, f"text {i} of a source named otherwise " * 3, f"other{i % 3}") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_all_sources_are_searched_at_all_phases(spark, tmp_path):
    from relweave.plans.queries import QUERIES

    got = QUERIES["gf2_bases_offsets"](spark, _few_documents(spark, tmp_path)).select("dataset_id").distinct().collect()
    assert {r["dataset_id"] for r in got} == {"other0", "other1", "other2"}


@pytest.mark.parametrize("name", ["container_accounting", "size_model_matches", "composed_gap", "composed_roundtrip", "harness"])
def test_container_queries_read_the_tables(spark, tmp_path, name):
    from relweave.plans.queries import QUERIES

    got = QUERIES[name](spark, _few_documents(spark, tmp_path)).collect()
    assert {"other0", "other1", "other2"} < {r["dataset_id"] for r in got}
    for passed in ("ok", "all_ok", "roundtrip_ok", "composed_roundtrip_ok"):
        assert all(r[passed] for r in got if passed in r.__fields__)


def test_composed_gap_compresses_once(spark, tmp_path):
    from relweave.plans.queries import QUERIES

    got = QUERIES["composed_gap"](spark, _few_documents(spark, tmp_path))
    assert "MapInPandas" not in got._jdf.queryExecution().toString()  # the gap reads the sizes three times


def test_harness_compresses_once(spark, tmp_path):
    from relweave.plans.queries import QUERIES

    # what is left to do after the query was planned: decoding the containers, and no codec
    plan = QUERIES["harness"](spark, _few_documents(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "back#" in plan


def test_absent_controls_do_not_pass(spark):
    rows = [("positive", "GF2", 0.5, 5000, 100, 60, 3, 480, True)]
    df = spark.createDataFrame(rows, "control string, codec_kind string, gap_pct double, gap_bytes long, dataset_bytes long, total_encoded_bytes long, framing_bits long, total_bits long, roundtrip_ok boolean")
    assert {r["gate"]: r["passed"] for r in metrics.control_gates(df).collect()} == {"positive": True, "null": False, "metadata": False, "framing": True, "roundtrip": True}
    assert not any(r["passed"] for r in metrics.control_gates(df.limit(0)).collect())
    sweep = spark.createDataFrame([("sweep", 0.0, 900), ("sweep", 0.1, 100), ("sweep", 0.2, 300)], "control string, phi double, gap_bytes long")
    assert not metrics.control_gates(sweep, ("sweep",)).first()["passed"]
    assert metrics.control_gates(sweep.where("phi < 0.2"), ("sweep",)).first()["passed"]
    assert not metrics.control_gates(sweep.withColumn("phi", -F.col("phi")), ("sweep",)).first()["passed"]


def test_nulls_are_no_function(spark):
    from relweave.operators import functional

    df = spark.createDataFrame([(1, 5), (1, None), (2, 6)], "k int, v int")
    for call in (lambda: functional.is_function_of(df, "v", ["k"]), lambda: functional.lookup_table(df, "v", ["k"]), lambda: functional.is_function_of(df, "k", ["v"])):
        with pytest.raises(ValueError):
            call()
    assert functional.is_function_of(df.dropna(), "v", ["k"])


def test_claims_are_typed(spark):
    ledger_rows = spark.createDataFrame([("a/b", 10_000_000, 0.25, True, "GF2", None)], "experiment_id string, n long, pct double, ok_flag boolean, kind string, note string")
    quoted = [("n", "10000000", True), ("n", "10000001", False), ("n", "10000000.0", False), ("pct", "0.2500000001", True), ("pct", "0.26", False), ("pct", "much", False), ("ok_flag", "True", True), ("ok_flag", "true", False), ("kind", "GF2", True), ("kind", "GF", False), ("note", "None", True), ("none", "1", False)]
    lines = [(i, f"x <!-- src: a/b / {f} = {v} --> y <!-- src: id / field = value -->") for i, (f, v, _) in enumerate(quoted)] + [(99, "<!-- src: nobody / n = 1 -->")]
    got = {r["line_no"]: r["ok"] for r in ledger.check_claims(spark.createDataFrame(lines, "line_no int, line string"), ledger_rows).collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(quoted)} | {99: False}


def test_tables_of_different_columns(spark, tmp_path):
    a, b = spark.createDataFrame([("x", 1)], "lang string, gap_bytes int"), spark.createDataFrame([("y", [1, 2])], "lang string, more array<int>")
    both = ledger.together([a, b])
    assert sorted(both.columns) == ["gap_bytes", "lang", "more"] and both.count() == 2
    for form in ("csv", "json", "parquet"):
        ledger.write_table(both, f"{tmp_path}/{form}", form)
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").where("lang = 'y'").first()["more"] == "[1,2]"
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.parquet(f"{tmp_path}/parquet").count() == 2
    assert {(r["lang"], r["total_gap_bytes"]) for r in ledger.rollup(both, ["lang"]).collect()} == {("x", 1), ("y", None), (None, 1)}


def test_merged_accounts():
    from relweave.functions.bits import merge_accounts

    assert merge_accounts({"payload_bits": 3}, {"payload_bits": 4, "crc_bits": 32}, {}) == {"payload_bits": 7, "crc_bits": 32}
