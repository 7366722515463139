"""Document operators against brute force: fingerprints, pieces, shingle joins, line dedup, mixing, sharding."""

import hashlib
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    rows = [(0, None, "en", "a", 0), (1, "", "en", None, 0), (2, " \n\t ", "en", "a", 4), (3, "one two", "en", "b", 7), (4, "One  two", "en", "b", 8)]
    base = prose(120)
    for i in range(5, 12):
        w = base.split()
        w[rnd.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w), "en", "a", 0))
    rows += [(i, base, "en", "a", 0) for i in range(12, 20)]
    shared = prose(60)
    rows += [(i, prose(40) + "\n" + shared + "\n" + prose(30), "fr", "c", 0) for i in range(20, 40)]
    rows += [(40, "\n".join(prose(20) for _ in range(400)), "fr", None, 0), (41, "é" * 3000, "fr", "c", 0), (None, "a null key stands here for no document", "fr", "c", 0), (41, "the same key once more with some words", "fr", "c", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def links(texts, k, num, den):
    """component of each key by comparing every pair."""
    sets = {d: shingles(t, k) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_jaccard_components(docs, k, num):
    from relweave.llm.jaccard_join import jaccard_components

    plain = docs.where("doc_id is null or doc_id != 41 or source is not null").withColumn("component_id", F.lit("clash"))
    plain = plain.where("doc_id is null or doc_id < 41")
    got = {r["doc_id"]: r for r in jaccard_components(plain, k=k, num=num).collect()}
    texts = {r["doc_id"]: r["text"] for r in plain.collect() if r["doc_id"] is not None}
    want, n = links(texts, k, num, 100)
    assert {d: got[d]["component_id"] for d in texts} == want
    assert {d: got[d]["n_shingles"] for d in texts} == n
    assert got[None]["component_id"] is None


def test_jaccard_empty_table(empty):
    from relweave.llm.jaccard_join import jaccard_components

    assert jaccard_components(empty).collect() == []


def test_rows_of_one_key_connect_what_they_link_with(spark):
    from relweave.llm.jaccard_join import jaccard_components

    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, a), (41, a), (41, b), (20, b), (41, None), (7, "something else that stands here alone"), (7, " ")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {x[:1] + x[2:] for x in got if x[1]} == {(3, 3), (41, 3), (20, 3), (7, 7)}


def test_many_variants_of_one_text(spark):
    """A large loose group: hardly any variant is near the leaders, chains connect them."""
    from relweave.llm.jaccard_join import jaccard_components

    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows, edited = [], list(base)
    for i in range(150):
        if i % 3 == 0:
            edited = list(edited if i % 30 else base)
            edited[rnd.randrange(60)] = f"x{i}"
        w = list(edited)
        w[rnd.randrange(60)] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[i - 150][1]) for i in range(150, 170)]
    want, n = links(dict(rows), 4, 85, 100)
    got = {r["doc_id"]: r for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want and {d: r["n_shingles"] for d, r in got.items()} == n
    assert 1 < len(set(want.values())) < 150


def test_a_family_of_texts_verifies_no_square_of_pairs(spark, monkeypatch):
    from relweave.llm import jaccard_join

    pairs, plain = [], jaccard_join._linked

    def counted(met, *more):
        pairs.append(met.count())
        return plain(met, *more)

    for name, value in {"_linked": counted, "TURNS": 0, "FEW_PAIRS": 50, "PAIRS_EACH": 4}.items():
        monkeypatch.setattr(jaccard_join, name, value, raising=False)
    rnd = random.Random(12)
    rows, base = [], [f"w{i}" for i in range(120)]
    for d in range(120):
        w = list(base)
        w[rnd.randrange(120)] = f"x{d}"
        rows.append((d, " ".join(w)))
    want, _ = links(dict(rows), 4, 85, 100)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85).collect()}
    assert got == want and len(set(want.values())) < 60
    assert 0 < sum(pairs) < 10 * len(rows)


def test_prefix_bound_never_rejects_a_link():
    import numpy as np

    from relweave.llm import jaccard_join as J
    from relweave.llm.shingles import mix

    rng = np.random.default_rng(1)
    linked, apart = [], []
    sign = lambda s: np.sort(mix(s) >> np.uint64(48)).astype("<u2")[: J.prefix_length(len(s), 85, 100)].tobytes()
    for _ in range(300):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        x = np.unique(pool[: rng.integers(1, 300)])
        y = np.unique(np.r_[x[rng.random(len(x)) > rng.choice([0.02, 0.1, 0.4, 0.97])], pool[300 : 300 + rng.integers(1, 20)]])
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            linked.append((len(x), len(y), sign(x), sign(y)))
        elif 10 * both < len(x):
            apart.append((len(x), len(y), sign(x), sign(y)))
    for pairs, share in ((linked, 1.0), (apart, 0.0)):
        nx, ny, xs, ys = zip(*pairs, strict=True)
        got = J.may_reach(np.array(nx), np.array(ny), list(xs), list(ys), 85, 100)
        assert len(pairs) > 10 and got.mean() == share or share == 0 and got.mean() < 0.2


def test_line_dedup(docs):
    from relweave.llm.line_dedup import dedup_lines

    one = docs.where("doc_id < 41").withColumn("row", F.lit("clash")).withColumn("h1", F.lit("clash"))
    one = one.withColumn("gone", F.lit("clash")).withColumn("lines", F.lit("clash")).withColumn("__gone", F.lit("clash"))
    got = {r["doc_id"]: r["text"] for r in dedup_lines(one).collect()}
    assert dedup_lines(one).columns == one.columns
    rows = sorted((r["doc_id"], r["text"]) for r in one.where("text is not null").collect())
    assert [got[d] for d, _ in rows] == word_set_oracle(rows)
    assert got[0] is None


def test_line_dedup_edges(spark, empty):
    from relweave.llm.line_dedup import dedup_lines

    assert dedup_lines(empty).collect() == []
    line = "a line that is long enough to be looked at here"
    twice = spark.createDataFrame([(7, line), (7, line), (8, line), (None, "short"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in dedup_lines(twice, counts=True).collect()), key=str)
    assert got == sorted([(7, line, 0), (7, line, 0), (8, "", 1), (None, "short", 0), (9, None, 0)], key=str)


@pytest.mark.parametrize("frequent,broadcast", [(3, 500_000), (0, 1)])
def test_frequent_words_are_joined_in_twos(spark, monkeypatch, frequent, broadcast):
    from relweave.llm import line_dedup

    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(5)
    common = [f"c{i}" for i in range(25)]
    rows = []
    for d in range(40):
        w = list(common) + [f"u{d}_{j}" for j in range(rnd.choice([1, 2, 9, 20]))]
        rows.append((d, " ".join(w)))
    rows += [(d, rows[d - 40][1]) for d in range(40, 50)]
    rows += [(50, "one"), (51, "one one\none two"), (52, "two one one\none\nthree"), (53, "four two three one\none two three four five")]
    few = [f"v{i}" for i in range(12)]
    rows += [(d, "\n".join(" ".join(rnd.choice(few) for _ in range(rnd.randint(1, 12))) for _ in range(5))) for d in range(54, 90)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == word_set_oracle(rows)


def test_frequent_words_in_several_rounds(spark, monkeypatch):
    from relweave.llm import line_dedup

    monkeypatch.setattr(line_dedup, "FREQUENT", 2)
    monkeypatch.setattr(line_dedup, "MOST_TWOS", 2000)
    rnd = random.Random(6)
    few = [f"v{i}" for i in range(14)]
    rows = [(d, "\n".join(" ".join(rnd.choice(few) for _ in range(rnd.randint(1, 14))) for _ in range(5))) for d in range(30)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == word_set_oracle(rows)


def test_word_levels_are_read_back_and_short_in_plans(spark):
    from relweave.llm import line_dedup

    lines = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500)))], "ord long, line string")
    levels = bytearray(i * 7 % 64 for i in range(1 << line_dedup.BUCKET_BITS))
    hashes = [r["h"] for r in spark.range(500).select(F.xxhash64(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("h")).collect()]
    of = [h % (1 << 64) >> 64 - line_dedup.BUCKET_BITS for h in hashes]
    want = sorted(levels[b] << 57 | h % (1 << 64) >> 7 for b, h in zip(of, hashes, strict=True))
    assert line_dedup.with_codes(lines, levels).first()["codes"] == want
    plan = line_dedup.with_codes(lines, line_dedup.word_levels(lines, "line"))._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 150_000


def test_the_join_on_single_words_reads_one_exchange(spark, monkeypatch):
    from relweave.llm import line_dedup

    plans, plain = [], line_dedup.materialize

    def seen(df, *name):
        if sys._getframe(1).f_code.co_name == "removed_lines" and df.columns == ["a", "b"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *name)

    monkeypatch.setattr(line_dedup, "materialize", seen)
    monkeypatch.setattr(line_dedup, "FREQUENT", 40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        rows = [(d, f"common {d % 9} a{d} b{d % 50}\nonly{d} c{d % 70} d{d % 70}") for d in range(200)]
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [got[d] for d, _ in rows] == word_set_oracle(rows)
    of_words = [line for line in plans[0].splitlines() if "Exchange hashpartitioning(word" in line]
    assert sum("ReusedExchange" not in line for line in of_words) == 1 and len(of_words) == 2


def test_plans_that_verify_hold_no_levels(spark, monkeypatch):
    from relweave.llm import line_dedup

    sizes, plain = [], line_dedup.materialize

    def seen(df, *name):
        if sys._getframe(1).f_code.co_name == "verified":
            sizes.append(len(df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, *name)

    monkeypatch.setattr(line_dedup, "materialize", seen)
    rows = [(d, " ".join([*(f"w{i}" for i in range(30)), f"x{d}"])) for d in range(5)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == word_set_oracle(rows)
    assert sizes and max(sizes) < 20_000


def test_a_family_of_lines_verifies_no_square_of_pairs(spark, monkeypatch):
    from relweave.llm import line_dedup

    pairs, plain = [], line_dedup.materialize

    def counted(df, *name):
        out = plain(df, *name)
        if sys._getframe(1).f_code.co_name == "verified" and out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    base, rows = [f"w{i}" for i in range(30)], []
    for d in range(150):
        w = list(base)
        w[d % 30] = f"x{d}"
        rows.append((d, " ".join(w)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == word_set_oracle(rows)
    assert 0 < sum(pairs) < 4 * len(rows)


def test_sentencepiece_matches_the_library(docs, spark):
    import public_tokenizers
    import sentencepiece

    from relweave.llm import sentencepiece_codec as S

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(1)
    odd = ["", " ", "a", "▁", " " * 37, "a" * 700, "<s> </s> <0x0A> <unk>", "\x00é日本語😀"] + ["".join(rnd.choice(" aeinrst▁\n\t<>|é日😀. thereing") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(odd)) + [(len(odd), None)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in S.token_digests(table, path).collect():
        ids = lib.encode((odd + [""])[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    back = S.decode_documents(S.encode_documents(docs, path), path)
    for r in back.collect():
        assert r["ids"] == lib.encode(r["text"] or "") and r["decoded"] == lib.decode(list(r["ids"]))
    assert S.encode_documents(docs.limit(0), path).collect() == []


def test_fingerprints(docs, empty):
    from relweave.llm import fingerprints as P

    assert P.fingerprint_edits(empty).collect() == []
    plain = docs.where("doc_id is not null and doc_id < 41")
    got = sorted(P.fingerprint_edits(plain).collect(), key=lambda r: -r["doc_id"])
    texts = [r["text"] or "" for r in sorted(plain.collect(), key=lambda r: -r["doc_id"])]
    assert len(got) == len(texts)
    for i, r in enumerate(got):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t, 5), shingles(edited, 5)
        if len(a) > 50:
            assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 0.2
        assert 0 <= r["near_next"] <= 1
    same = {}
    for t, r in zip(texts, got, strict=True):
        assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert P.likeness("", "") == 1.0 and P.likeness("", got[5]["fingerprint"]) == 0.0
    assert len(P.fingerprint_edits(docs).collect()) == docs.count()


def test_likeness_is_unbiased():
    import numpy as np

    from relweave.llm import fingerprints as P

    rng = random.Random(2)
    errors = []
    for share in (0.2, 0.5, 0.9):
        for _ in range(15):
            a = [f"w{rng.random()}" for _ in range(400)]
            b = a[: int(400 * share)] + [f"v{rng.random()}" for _ in range(400 - int(400 * share))]
            x, y = shingles(" ".join(a), 5), shingles(" ".join(b), 5)
            p, q = P.fingerprints([" ".join(a), " ".join(b)])
            errors.append(P.likeness(p, q) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_mixing(docs, empty, spark):
    from relweave.llm.mixing import mix_sources

    assert mix_sources(empty).collect() == []
    got = mix_sources(docs.withColumn("target", F.lit("clash"))).collect()
    again = mix_sources(docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["source_size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    rows = {(r["doc_id"], len(WORD.findall(r["text"] or ""))): r["source"] for r in docs.collect()}
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(rows[r["doc_id"], r["size"]], []).append(r)
    sizes = {s: sum(r["size"] for r in g) for s, g in by.items()}
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}
    target, left, free = {}, sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s], left = 3 * sizes[s], left - 3 * sizes[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    for s, g in by.items():
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) for r in g)
        assert abs(sum(r["taken"] for r in g) - target[s]) <= 4 * 32 + 0.001 * target[s]


def test_apportion_is_sainte_lague(spark):
    import heapq

    from relweave.llm.mixing import apportion

    rnd = random.Random(8)
    for seats in (0, 1, 7, 100, 1001):
        weights = [rnd.randint(1, 1000) / 7 for _ in range(9)]
        df = spark.createDataFrame([(1, i, w, seats) for i, w in enumerate(weights)], "g int, __order long, w double, seats long")
        got = {r["__order"]: r["q"] for r in apportion(df, ["g"], "w", "seats", "q").collect()}
        heap = [(-w, i, 0) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        want = dict.fromkeys(range(9), 0)
        for _ in range(seats):
            _, i, n = heapq.heappop(heap)
            want[i] = n + 1
            heapq.heappush(heap, (-weights[i] / (2 * n + 3), i, n + 1))
        assert got == want


def test_apportion_with_one_large_and_many_small(spark):
    import heapq

    from relweave.llm.mixing import apportion

    for weights, seats, cap in (([10_000.0] + [0.6] * 300, 10_600, None), ([5.0] * 40, 31, None), ([100.0] + [1.0] * 50, 130, 2)):
        df = spark.createDataFrame([(1, i, w, seats, cap or seats) for i, w in enumerate(weights)], "g int, __order long, w double, seats long, cap long")
        got = {r["__order"]: r["q"] for r in apportion(df, ["g"], "w", "seats", "q", "cap").collect()}
        heap = [(-w, i, 0) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        want = dict.fromkeys(range(len(weights)), 0)
        for _ in range(seats):
            if not heap:
                break
            _, i, n = heapq.heappop(heap)
            want[i] = n + 1
            if n + 1 < (cap or seats):
                heapq.heappush(heap, (-weights[i] / (2 * n + 3), i, n + 1))
        assert got == want


def test_mixing_of_small_sources_comes_near_their_targets(spark):
    from relweave.llm.mixing import BLOCK, mix_sources

    rnd = random.Random(12)
    text = lambda n: " ".join(rnd.choice("abcdefg") for _ in range(n))
    rows = [(i, text(20), f"s{i:03}") for i in range(60)] + [(100 + i, text(100), "s060") for i in range(100)] + [(300 + i, text(rnd.randint(1, 9)), f"t{i % 7}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {r[0]: r[2] for r in rows}
    taken, target = {}, {}
    got = mix_sources(df).collect()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= BLOCK for s in target)
    other = {r["doc_id"]: r["taken"] for r in mix_sources(df, seed=12).collect()}
    assert any(other[r["doc_id"]] != r["taken"] for r in got if source[r["doc_id"]] == "s060")


def test_a_text_larger_than_a_shard(spark):
    from relweave.llm.sharding import shard_by_bytes

    rows = [(0, "x" * 5000), (1, "x" * 5000)] + [(i, f"t{i}") for i in range(2, 60)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and len({r["shard"] for r in got if r["doc_id"] < 2}) == 1
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_sharding(docs, empty):
    from relweave.llm.sharding import shard_by_bytes

    assert shard_by_bytes(empty).collect() == []
    rows = docs.withColumn("shard", F.lit("clash"))
    got = shard_by_bytes(rows).collect()
    assert len(got) == docs.count()
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    texts = {(r["doc_id"], len((r["text"] or "").encode()) + 1): r["text"] for r in docs.collect()}
    where = {}
    for r in got:
        t = texts[r["doc_id"], r["size"]]
        assert r["text_crc32"] == zlib.crc32((t or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        assert where.setdefault(t, r["shard"]) == r["shard"]


def test_shards_are_near_equal(spark):
    from relweave.llm.sharding import shard_by_bytes

    rnd = random.Random(4)
    df = spark.createDataFrame([(i, "x" * rnd.randint(0, 200) + str(i)) for i in range(5000)], "doc_id long, text string")
    got = shard_by_bytes(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    total = [r["b"] for r in got]
    assert len(total) == 8 and max(total) - min(total) <= 450


def word_set_oracle(rows, num=80):
    """As line_oracle, but a line is the set of its words, and every line that has one takes part."""
    seen, out = [], []
    for _, text in rows:
        kept = []
        for line in text.split("\n"):
            s = {x for x in re.split(r"[\x20\x09\x0b-\x0d]+", line) if x}
            if not s or not any(100 * len(s & o) >= num * len(s | o) for o in seen):
                kept.append(line)
            seen += [s] if s else []
        out.append("\n".join(kept))
    return out


def test_lines_are_sets_of_words(spark):
    from relweave.llm.line_dedup import dedup_lines

    rnd = random.Random(11)
    rows = []
    for n in (10, 20, 30, 40):
        line = [f"word{n}x{i}" for i in range(n)]
        rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join([*line[: n // 2], "changed", *line[n // 2 + 1 :]]))]
    vocabulary = [f"vocab{i}" for i in range(14)]
    rows += [(d, "\n".join(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(4, 30))) for _ in range(4))) for d in range(len(rows), 60)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == word_set_oracle(rows)
    assert [got[d] for d in range(1, 8, 2)] == [""] * 4


def test_short_lines_take_part(spark):
    from relweave.llm.line_dedup import dedup_lines

    rows = [(1, "Read more\n\nSubscribe now!\n \t"), (2, "Read more\n\nmore Read\nx"), (3, "Subscribe now!\n \t\nx\nRead less\nRead  more")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == word_set_oracle(rows) == ["Read more\n\nSubscribe now!\n \t", "\nx", " \t\nRead less"]


def test_heads_of_lines_deal_out_no_texts(spark, monkeypatch):
    from relweave.llm import line_dedup

    plans, plain = [], line_dedup.materialize

    def seen(df, *name):
        plans.append(df._jdf.queryExecution().executedPlan().toString() if "head" in df.columns else "")
        return plain(df, *name)

    monkeypatch.setattr(line_dedup, "materialize", seen)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 1)  # as for tables of size
    rows = [(d, f"common {d % 9} a{d} b{d % 50}\nonly{d} c{d % 70} d{d % 70}\ncommon line of all") for d in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == word_set_oracle(rows)
    assert sum(map(bool, plans)) and not any("Join" in x for x in plans)
    assert sum("Exchange" in x for x in plans) == 2 and not any("Exchange" in x and "split" in x for x in plans)
