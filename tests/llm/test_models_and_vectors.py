"""Classifiers by held-out accuracy and defined edges, url filters and embeddings by brute force, components, pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

TEXTS = "doc_id long, text string"


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = [a + b for a in ("ba", "do", "ke", "lu", "mi", "no") for b in ("ra", "sel", "tin", "vo", "wen")]
    docs, quality, toxic = [], [], []
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 200))]
        bad, rude = i % 4 == 0, i % 5 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 else [x + "$$$" for x in w]
        if rude:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["grobnik", "zwask", "plurt"]))
        docs.append((i, " ".join(w)))
        quality.append(int(not bad)), toxic.append(int(rude))
    return docs, quality, toxic


def accuracy(scored, label, held, threshold):
    rows = [r for r in scored if r["doc_id"] in held]
    return sum((r["score"] >= threshold) == label[r["doc_id"]] for r in rows) / len(rows)


@pytest.fixture(scope="module")
def labelled(spark):
    docs, quality, toxic = corpus(400, 1)
    table = spark.createDataFrame(docs, TEXTS).withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([*zip(range(400), quality, toxic, strict=True), (None, 1, 1), (3, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    return table, labels, quality, toxic


ODD = [(None, "no key"), (1, None), (2, ""), (3, " \n "), (4, "x" * 200_000), (5, "12 34 $$"), (6, "twin words here"), (7, "twin words here")]


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_classifiers(spark, labelled, name):
    import importlib

    m = importlib.import_module(f"relweave.llm.{name}")
    table, labels, quality, toxic = labelled
    label = {"quality": quality, "toxicity": toxic}[name]
    model = m.train(table, labels, lambda k: k % 3 != 1)
    scored = m.score_documents(table, model).collect()
    held = {i for i in range(400) if i % 3 == 1}
    assert accuracy(scored, label, held, m.THRESHOLD) > 0.95
    odd = {r["doc_id"]: r["score"] for r in m.score_documents(spark.createDataFrame(ODD, TEXTS), model).collect()}
    assert all(0 <= s <= 1 for s in odd.values()) and odd[1] == odd[2] and odd[6] == odd[7]
    assert m.score_documents(table.limit(0), model).collect() == []
    again = m.train(table.repartition(5), labels, lambda k: k % 3 != 1)
    two = {r["doc_id"]: r["score"] for r in m.score_documents(table, again).collect()}
    assert max(abs(two[r["doc_id"]] - r["score"]) for r in scored) < 1e-6


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_classifiers_without_labels(spark, labelled, name):
    import importlib

    m = importlib.import_module(f"relweave.llm.{name}")
    table, labels, _, _ = labelled
    for some in (labels.limit(0), labels.where("quality = 1 and toxic = 0")):
        model = m.train(table, some, lambda k: F.lit(True))
        assert {r["score"] for r in m.score_documents(table, model).collect()} == {{"quality": 0.5, "toxicity": 0.02}[name]}


def test_bradley_terry_orders_by_preference():
    from relweave.llm.quality import NAMES, fit

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(NAMES)))
    label = (x[:, 0] + 0.1 * rng.normal(size=300) > -1).astype(int)
    model = fit(x, label)
    assert np.corrcoef(model.strength(x), x[:, 0])[0, 1] > 0.95
    assert abs(((model.score(x) >= 0.3) == label).mean()) > 0.95


def test_toxicity_gradients():
    from relweave.llm import toxicity as T

    rng = np.random.default_rng(0)
    h = 3
    p = {"u": rng.normal(size=(2, h, 3 * h)), "wa": rng.normal(size=(2 * h, 4)), "va": rng.normal(size=4), "wo": rng.normal(size=2 * h), "bo": np.zeros(1)}
    gates, mask = rng.normal(size=(5, 6, 2, 3 * h)), np.arange(6) < np.array([6, 4, 1, 6, 3])[:, None]
    d = rng.normal(size=5)
    _, saved = T._forward(p, gates, mask, keep=True)
    grad, d_gates = T._backward(p, saved, mask, d)
    for name, at in (("u", (1, 2, 4)), ("wa", (3, 1)), ("va", (2,)), ("wo", (4,))):
        old, e = p[name][at], 1e-6
        ends = []
        for s in (e, -e):
            p[name][at] = old + s
            ends.append(T._forward(p, gates, mask)[0] @ d)
        p[name][at] = old
        assert abs((ends[0] - ends[1]) / (2 * e) - grad[name][at]) < 1e-5
    g = gates.copy()
    g[3, 2, 1, 5] += 1e-6
    assert abs((T._forward(p, g, mask)[0] - T._forward(p, gates, mask)[0]) @ d / 1e-6 - d_gates[3, 2, 1, 5]) < 1e-4


def test_windows_cover_and_overlap():
    from relweave.llm.toxicity import STRIDE, WINDOW, window_starts

    for n in (1, 39, 40, 41, 70, 71, 100, 1000):
        seen = {i for s in window_starts(n) for i in range(s, min(n, s + WINDOW))}
        assert seen == set(range(n)) and all(b - a == STRIDE for a, b in zip(window_starts(n), window_starts(n)[1:], strict=False))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "allow"), ("net", "", "block"), ("b.c", "/a", "block"), ("b.c", "/aa", "allow"), ("b.c", "/aab", "block")]


def judged(url):
    import re

    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


def test_url_filters(spark):
    from relweave.llm.url_filters import judge_urls

    rnd = random.Random(6)
    urls = [None, "", "no scheme", "http://", "http:///path", "HTTP://WWW.Example.COM/en/x?y#z", "a://.com/", "a://com", "a://com/?q", "a://x.net?q=/es/", "a://x..com/", "a://com\x01example/en/", "x://é.com/en/" + "y" * 5000, "a://" + "d." * 300 + "com/"]
    urls += [f"http://{rnd.choice(['', 'www.', 'm.'])}{rnd.choice(['example.com', 'b.c', 'x.net', 'net', 'xnet', 'badexample.com', 'a.b.c'])}{rnd.choice(['', '/', '/en/', '/es/1', '/aab', '/aa', '/ab', '/a'])}" for _ in range(300)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(5, urls[5]), (None, urls[5])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("key", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, rules).collect()), key=str)
    assert got == sorted(((i, *judged(u)) for i, u in rows), key=str)
    assert judge_urls(df.limit(0), rules).collect() == []
    assert {r["verdict"] for r in judge_urls(df, rules.limit(0), default="block").collect()} == {"block"}


def vectors(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(120, 8))
    near = np.concatenate([x[:30] + rng.normal(scale=s, size=(30, 8)) for s in (0.05, 0.2, 0.35, 0.5)])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near, x[:10], 3 * x[10:20]]))]
    n = len(rows)
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [None] + [1.0] * 7, [1.0] * 5, [1e-300] * 8, [1e300] * 8]
    return rows + [(n + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1])]


@pytest.mark.parametrize("block,leaf", [(4096, 512), (16, 4)])
def test_embeddings(spark, monkeypatch, block, leaf):
    from relweave.llm import epsilon_grid as E

    monkeypatch.setattr(E, "BLOCK_ROWS", block)
    monkeypatch.setattr(E, "LEAF", leaf)
    rows = vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).repartition(3)
    got = {r["vec_id"]: r for r in E.near_duplicates(df).collect()}
    good = {i: np.array(v) / np.abs(v).max() for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    root = {i: i for i, _ in rows if i is not None}
    n = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in unit:
        for b in unit:
            if a < b and unit[a] @ unit[b] >= 0.9:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: got[i]["n_links"] for i in root} == n
    assert {i: got[i]["component_id"] for i in root} == {i: find(i) for i in root}
    assert all(got[i]["kept"] == (find(i) == i) for i in root)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)


def test_each_length_is_joined(spark):
    from relweave.llm.epsilon_grid import near_duplicates

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.1, 0.0]), (7, [1.0] * 5), (8, [2.0]), (2, [0.0, 1.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1), (4, 2, 4), (5, 2, 4), (6, 2, 4), (7, 0, 7), (8, 0, 8)]


def test_blocks_follow_cells():
    from relweave.llm.epsilon_grid import block_starts

    rnd = random.Random(4)
    for _ in range(200):
        cells, rows = [rnd.choice([1, 2, 5, 30, 200]) for _ in range(rnd.randint(1, 30))], rnd.choice([4, 16, 100])
        starts, at, blocks = block_starts(cells, rows), 0, []
        for n, (start, base) in zip(cells, starts, strict=True):
            blocks += [base + (r - start) // rows for r in range(at, at + n)]
            at += n
        assert all(y - x in (0, 1) for x, y in zip(blocks, blocks[1:])) and blocks[0] == 0
        assert max(blocks.count(b) for b in set(blocks)) <= rows and len(set(blocks)) <= 2 * sum(cells) / rows + len(cells)


def test_distant_blocks_are_skipped(spark, monkeypatch):
    from relweave.llm import epsilon_grid as E

    monkeypatch.setattr(E, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(7)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    rows = [(int(i * 40 + j), (centres[i] + rng.normal(scale=0.02, size=16)).tolist()) for i in range(16) for j in range(40)]
    classes = spark.createDataFrame([(i, 1, v) for i, v in rows], "rep long, many long, v array<double>")
    placed, sent, _ = E.units_of(classes, 16, 0.9)
    blocks = placed.select("block").distinct().count()
    assert blocks >= 20 and sent.select("unit").distinct().count() < 0.4 * blocks * (blocks + 1) / 2
    assert E._linked(classes, 16, 0.9).groupBy("id").agg(F.sum("n").alias("n")).where("n = 39").count() == 640


def test_embeddings_empty(spark):
    from relweave.llm.epsilon_grid import near_duplicates

    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0]["kept"]


def test_components(spark):
    from relweave.llm.components import connected_components

    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r["node"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {i: i for e in edges for i in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {i: r for i, r in root.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, quality, _ = corpus(120, 9)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs] + [(200 + i, docs[i][1], "en", "s0", 1) for i in range(1, 20)] + [(300, None, None, None, None), (301, "", "en", None, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, given = {}, table
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, str(tmp_path))
        assert name == "encode" or out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        given = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r["doc_id"] for r in given.collect()]
    good = {i for i in range(120) if quality[i]}
    assert good <= set(kept["quality"]) and not (set(range(120)) - good) & set(kept["quality"])
    assert sorted(kept["line_dedup"]) == sorted(kept["quality"])
    assert len(kept["near_duplicates"]) <= len(kept["line_dedup"]) and good <= set(kept["near_duplicates"])
    assert max(kept["mixing"].count(i) for i in kept["mixing"]) <= 3 and set(kept["mixing"]) <= set(kept["near_duplicates"])
    assert sorted(kept["encode"]) == sorted(kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["encode"])


def test_long_runs_of_letters_are_read_whole():
    import numpy as np

    from relweave.llm import toxicity as T

    run = "".join(chr(0x4E00 + i) for i in range(500))
    for n in (1, 40, 41, 70, 71, 500):
        pieces = T.words_of("a " + run[:n])[1:]
        assert all(len(p) <= T.PIECE for p in pieces)
        assert {run[i : i + 3] for i in range(n - 2)} <= {p[i : i + 3] for p in pieces for i in range(len(p) - 2)}
    rng = np.random.default_rng(2)
    words = [[f"w{rng.integers(50)}" for _ in range(12)] for _ in range(40)]
    model = T.fit(words, np.arange(40) % 2, ["w1", "w2"], np.array([1.0, -1.0]), updates=3, batch=8)
    plain, other = T._Scorer(model).scores([run, run[:450] + "horrid" + run[456:]])
    assert plain != other


def test_masked_spellings_reach_the_network():
    from relweave.llm import toxicity as T

    assert T.words_of('"Gr0b-n*ik," he_said (5 times) $$ !') == ["gr0b-n*ik", "he_said", "5", "times"]
    assert T.words_of("$$ !! _") == [] == T.words_of(None)


def test_the_network_reads_order_that_counts_cannot():
    """Ablation: single words go equally with both labels, so a start from their counts knows nothing; only their order tells."""
    from relweave.llm import toxicity as T

    rng = np.random.default_rng(6)
    filler = [f"fill{i}" for i in range(12)]

    def window(label):
        w = [filler[i] for i in rng.integers(0, 12, 10)]
        at = rng.integers(0, 9)
        w[at : at + 2] = ["kara", "moru"] if label else ["moru", "kara"]
        return w

    label = np.arange(900) % 2
    windows = [window(y) for y in label]
    vocabulary = ["kara", "moru", *filler]
    model = T.fit(windows[:700], label[:700], vocabulary, np.zeros(len(vocabulary)))
    got = T._Scorer(model).scores([" ".join(w) for w in windows[700:]])
    assert ((got >= 0.5) == label[700:]).mean() > 0.9


def test_scores_equal_a_loop_over_windows():
    """The batched scorer against one window and one step at a time."""
    from relweave.llm import toxicity as T

    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(30)]
    windows = [[vocabulary[i] for i in rng.integers(0, 30, 20)] for _ in range(60)]
    model = T.fit(windows, np.arange(60) % 2, vocabulary, np.zeros(30), updates=5, batch=16)
    p, h = model.params, model.params["u"].shape[1]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def run(gates, k):
        state, out = np.zeros(h), []
        for g in gates:
            hu = state @ p["u"][k]
            z, r = sigmoid(g[:h] + hu[:h]), sigmoid(g[h : 2 * h] + hu[h : 2 * h])
            state = state + z * (np.tanh(g[2 * h :] + r * hu[2 * h :]) - state)
            out.append(state)
        return out

    def score(text):
        words, worst = T.words_of(text), -np.inf
        for s in T.window_starts(len(words)):
            g = model.inputs(words[s : s + T.WINDOW]).astype(float)
            both = np.concatenate([run(g[:, 0], 0), run(g[::-1, 1], 1)[::-1]], axis=1)
            e = np.tanh(both @ p["wa"]) @ p["va"]
            a = np.exp(e - e.max())
            worst = max(worst, ((a / a.sum()) @ both @ p["wo"] + p["bo"][0]) * model.scale + model.shift)
        return sigmoid(worst) if words else T.NOTHING

    texts = [" ".join(vocabulary[i] if i < 30 else f"odd{i}" for i in rng.integers(0, 40, n)) for n in (0, 1, 39, 40, 41, 70, 71, 200)] + [None]
    assert np.allclose(T._Scorer(model).scores(texts), [score(t) for t in texts], atol=1e-4)


def test_pipeline_with_clashing_columns_and_without_labels(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(21)
    prose = lambda n: " ".join(f"w{rnd.randrange(400)}" for _ in range(n))
    rows = [(i, prose(80)) for i in range(20)]
    rows += [(100 + i, rows[i][1] + " and one more") for i in range(10)] + [(None, rows[3][1]), (200, None), (200, "")]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "copy", "whole", "size", "target", "taken", "kept", "lines", "to", "text_", "__keep", "__gone"):
        table = table.withColumn(c, F.lit("clash"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near_duplicates"](spark, table, str(tmp_path))
    assert near.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in near.collect()) == sorted([*map(str, range(20)), "None", "200", "200"])
    for name in ("quality", "line_dedup", "mixing"):
        out = stages[name](spark, table, str(tmp_path))
        assert out.columns == table.columns and {r["whole"] for r in out.collect()} == {"clash"}
    assert all(stages[name](spark, table.limit(0), str(tmp_path)).collect() == [] for name in stages)


def test_mixing_stage_carries_no_texts(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from relweave.llm import mixing

    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{rnd.randrange(90)}" for _ in range(rnd.randrange(1, 60))), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += rows[:5] * 3 + [(90, None, "en", "s0", 0), (90, "en", None, "s0", 0), (91, "two words", None, None, 0), (91, None, "two words", None, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = []
    for r in mixing.mix_sources(table.select("*", F.xxhash64(F.lit(23), "doc_id", "text").alias("h")), keep=["text", "lang", "source", "h"]).collect():
        want += [(r["doc_id"], r["text"], r["lang"], r["source"], 0)] * int(r["taken"] / r["size"] + r["h"] % 1_000_000 / 1_000_000 if r["taken"] else 0)
    written, plain = [], mixing.materialize
    for module in (mixing, corpus_pipeline):
        monkeypatch.setattr(module, "materialize", lambda df, *name: written.append(df.schema.simpleString()) or plain(df, *name))
    out = dict(corpus_pipeline.STAGES)["mixing"](spark, table, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want)) and len(want) > 60
    assert written and not any("text" in x for x in written)
