"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a learned vector of the word (of a vocabulary chosen on the training rows; others share one) beside
the mean of learned vectors of its hashed character trigrams. A word runs from a letter or digit to the last one before
white space, with whatever lies between (masked spellings stay whole). A word of more than ``PIECE`` characters (text
without spaces) counts as words of ``PIECE`` that start every ``PIECE_STRIDE`` characters and cover it. The network reads windows of ``WINDOW`` words that start
every ``STRIDE`` words, so they overlap and cover the whole text; attention pools the states of both directions; a
text's score is its worst window's.

Training: at most ``TRAIN_ROWS`` labelled rows, the first by a hash of their key. Of each, the windows with the most
telling words and seeded others are drawn on the executors, so the driver gets at most ``WINDOWS_A_ROW`` windows a row.

Defined results: null and empty texts and texts without letters and digits have no window and score ``NOTHING``; texts of any
length are read whole; without both labels every text scores ``NOTHING``; rows whose label or key is null are not
learned from; equal texts score equally; an empty table gives an empty table; other columns are no inputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.shingles import chunks
from relweave.runtime import materialize, release

TRAIN_ROWS = 12_000
WINDOWS_A_ROW = 3
VOCABULARY = 6_000
WINDOW, STRIDE = 40, 30
PIECE, PIECE_STRIDE = 40, 30
THRESHOLD = 0.7
NOTHING = 0.02
TRIGRAMS = 1 << 11
#: Words whose inputs a Python worker remembers.
CACHE_WORDS = 150_000
WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
_WORD_DIM, _CHAR_DIM, _HIDDEN, _ATTENTION = 8, 6, 8, 8


def words_of(text: str | None) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    if all(len(w) <= PIECE for w in found):
        return found
    return [w[s : s + PIECE] for w in found for s in range(0, max(1, len(w) - (PIECE - PIECE_STRIDE)), PIECE_STRIDE)]


def trigrams(word: str) -> list[int]:
    s = f"<{word}>"
    return [zlib.crc32(s[i : i + 3].encode("utf-8", "surrogatepass")) % TRIGRAMS for i in range(len(s) - 2)]


def window_starts(n: int) -> range:
    """Starts of windows that cover n words and overlap by WINDOW - STRIDE."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE) if n else range(0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    params: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0

    def inputs(self, words: list[str]) -> np.ndarray:
        """(words, 2, 3 h): what each word adds to the gates of either direction."""
        p = self.params
        ids = np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)
        grams = [trigrams(w) for w in words]
        size = np.array([len(g) for g in grams])
        flat = np.array([x for g in grams for x in g], dtype=np.int64)
        chars = np.add.reduceat(p["chars"][flat], np.cumsum(size) - size) / size[:, None]
        x = np.concatenate([p["words"][ids], chars], axis=1)
        return (np.einsum("nd,kdg->nkg", x, p["wx"]) + p["bx"]).astype(np.float32)

    def logits(self, gates: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """gates: (windows, steps, 2, 3 h); mask: (windows, steps)."""
        out, _ = _forward(self.params, gates, mask)
        return out * self.scale + self.shift


def _forward(p: dict, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
    n, steps, h = len(mask), mask.shape[1], p["u"].shape[1]
    state = np.zeros((2, n, h), dtype=gates.dtype)
    states = np.zeros((2, steps, n, h), dtype=gates.dtype)
    tape = []
    m2 = np.stack([mask, mask[:, ::-1]]).astype(gates.dtype)
    u = p["u"].astype(gates.dtype)
    for t in range(steps):
        g = np.stack([gates[:, t, 0], gates[:, steps - 1 - t, 1]])
        hu = state @ u
        zr = 1 / (1 + np.exp(-(g[..., : 2 * h] + hu[..., : 2 * h])))
        z, r = zr[..., :h], zr[..., h:]
        c = np.tanh(g[..., 2 * h :] + r * hu[..., 2 * h :])
        m = m2[:, :, t, None]
        if keep:
            tape.append((state, z, r, c, hu[..., 2 * h :], m))
        state = state + m * z * (c - state)
        states[:, t] = state
    both = np.concatenate([states[0], states[1, ::-1]], axis=-1).transpose(1, 0, 2)  # (windows, steps, 2 h)
    a = np.tanh(both @ p["wa"].astype(gates.dtype))
    e = np.where(mask, a @ p["va"].astype(gates.dtype), -1e9)
    weight = np.exp(e - e.max(axis=1, keepdims=True)) * mask
    weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
    pooled = np.einsum("nt,nth->nh", weight, both)
    return pooled @ p["wo"].astype(gates.dtype) + p["bo"][0], (tape, both, a, weight, pooled)


def _backward(p: dict, saved, mask: np.ndarray, d_out: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of the gates."""
    tape, both, a, weight, pooled = saved
    h, steps = p["u"].shape[1], mask.shape[1]
    grad = {"wo": pooled.T @ d_out, "bo": np.array([d_out.sum()])}
    d_pooled = d_out[:, None] * p["wo"]
    d_both = weight[:, :, None] * d_pooled[:, None, :]
    d_weight = np.einsum("nth,nh->nt", both, d_pooled)
    d_e = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    grad["va"] = np.einsum("nt,ntk->k", d_e, a)
    d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
    grad["wa"] = np.einsum("nth,ntk->hk", both, d_a)
    d_both += d_a @ p["wa"].T
    d_states = np.stack([d_both[..., :h].transpose(1, 0, 2), d_both[..., h:].transpose(1, 0, 2)[::-1]])
    d_gates = np.zeros((len(mask), steps, 2, 3 * h))
    grad["u"] = np.zeros_like(p["u"])
    carry = np.zeros((2, len(mask), h))
    for t in reversed(range(steps)):
        state, z, r, c, hc, m = tape[t]
        d = carry + d_states[:, t]
        dn = m * d
        dc = dn * z * (1 - c * c)
        dz, dr = dn * (c - state) * z * (1 - z), dc * hc * r * (1 - r)
        d_hu = np.concatenate([dz, dr, dc * r], axis=-1)
        grad["u"] += state.transpose(0, 2, 1) @ d_hu
        carry = d - dn * z + d_hu @ p["u"].transpose(0, 2, 1)
        dg = np.concatenate([dz, dr, dc], axis=-1)
        d_gates[:, t, 0] = dg[0]
        d_gates[:, steps - 1 - t, 1] = dg[1]
    return grad, d_gates


def fit(windows: list[list[str]], label: np.ndarray, vocabulary: list[str], telling: np.ndarray, updates: int = 240, batch: int = 192, seed: int = 5) -> ToxicityModel | None:
    """Adam on the logistic loss; half of each batch is toxic. ``telling``: how strongly each vocabulary word goes with the label."""
    pos, neg = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(pos) or not len(neg):
        return None
    rng = np.random.default_rng(seed)
    vocab = {w: i + 1 for i, w in enumerate(vocabulary)}
    h, d = _HIDDEN, _WORD_DIM + _CHAR_DIM
    p = {
        "words": rng.normal(0, 0.1, (len(vocab) + 1, _WORD_DIM)), "chars": rng.normal(0, 0.1, (TRIGRAMS, _CHAR_DIM)),
        "wx": rng.normal(0, d**-0.5, (2, d, 3 * h)), "bx": np.zeros((2, 3 * h)), "u": rng.normal(0, h**-0.5, (2, h, 3 * h)),
        "wa": rng.normal(0, 0.3, (2 * h, _ATTENTION)), "va": rng.normal(0, 0.3, _ATTENTION), "wo": rng.normal(0, 0.3, 2 * h), "bo": np.zeros(1),
    }
    p["words"][1:, 0] = np.clip(telling / 4, -1, 2)  # the first dimension starts from the counts
    unique = sorted({w for ws in windows for w in ws})
    code = {w: i for i, w in enumerate(unique)}
    ids = np.array([vocab.get(w, 0) for w in unique])
    grams = [trigrams(w) for w in unique]
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    table = np.full((len(windows), WINDOW), -1)
    for i, ws in enumerate(windows):
        table[i, : len(ws)] = [code[w] for w in ws]

    def read(rows):
        used, at = np.unique(table[rows], return_inverse=True)
        at = at.reshape(len(rows), WINDOW)
        if used[0] < 0:
            used = used.copy()
            used[0] = used[1] if len(used) > 1 else 0  # a masked place reads any word
        size = np.array([len(grams[i]) for i in used])
        flat = np.array([g for i in used for g in grams[i]])
        chars = np.add.reduceat(p["chars"][flat], np.cumsum(size) - size) / size[:, None]
        x = np.concatenate([p["words"][ids[used]], chars], axis=1)
        return used, at, size, flat, x, table[rows] >= 0

    for step in range(1, updates + 1):
        rows = np.r_[rng.choice(pos, batch // 2), rng.choice(neg, batch // 2)]
        used, at, size, flat, x, mask = read(rows)
        gates = (np.einsum("nd,kdg->nkg", x, p["wx"]) + p["bx"])[at]
        out, saved = _forward(p, gates, mask, keep=True)
        grad, d_gates = _backward(p, saved, mask, (_sigmoid(out) - label[rows]) / len(rows))
        d_word = np.zeros((len(used), 2, 3 * h))
        np.add.at(d_word, at.ravel(), d_gates.reshape(-1, 2, 3 * h))
        grad["bx"], grad["wx"] = d_word.sum(axis=0), np.einsum("nd,nkg->kdg", x, d_word)
        dx = np.einsum("nkg,kdg->nd", d_word, p["wx"])
        grad["words"], grad["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(grad["words"], ids[used], dx[:, :_WORD_DIM])
        np.add.at(grad["chars"], flat, np.repeat(dx[:, _WORD_DIM:] / size[:, None], size, axis=0))
        rate = 0.02 * min(1.0, 3 * (1 - step / (updates + 1)))
        for k, g in grad.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
    model = ToxicityModel(vocab, p)
    out = np.concatenate([_forward(p, (np.einsum("nd,kdg->nkg", x, p["wx"]) + p["bx"])[at], mask)[0] for lo in range(0, len(windows), 512) for _, at, _, _, x, mask in [read(np.arange(lo, min(lo + 512, len(windows))))]])
    # the middle between clean windows' upper and toxic windows' lower end becomes the score 0.5
    low, high = np.quantile(out[pos], 0.05), np.quantile(out[neg], 0.999)
    model.scale = 6 / max(abs(low - high), 1.0)
    model.shift = -(low + high) / 2 * model.scale
    return model


def train(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicityModel | None:
    """A model from the labelled documents for whose key ``learn(column)`` holds; None without both labels."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & learn(F.col(key))).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("__key"), "__key", "__label").limit(rows)  # at most `rows` rows of two numbers: safe to broadcast
    source = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")
    # of rows that repeat a key one is learned from: a bounded number of windows reaches the driver
    source = source.groupBy("__key", "__label").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    source = materialize(source.select(F.col("__key").cast("string"), "__label", "__text"), "toxicity")

    def spread(batches):
        for batch in batches:
            got = [(w, y) for t, y in zip(batch["__text"].tolist(), batch["__label"].tolist(), strict=True) for w in [*set(words_of(t)), ""]]
            part = pd.DataFrame(got, columns=["word", "label"]).groupby(["word", "label"]).size().reset_index(name="n")
            yield part

    counted = source.mapInPandas(spread, "word string, label int, n long").groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c"))
    total = counted.where("word = ''").first()
    if total is None or not total["t"] or not total["c"]:
        release(source)
        return None
    big_t, big_c = float(total["t"]), float(total["c"])
    odds = F.log((F.col("t") + 0.5) / (F.lit(big_t) - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (F.lit(big_c) - F.col("c") + 0.5))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5) + 1 / (F.lit(big_t) - F.col("t") + 0.5) + 1 / (F.lit(big_c) - F.col("c") + 0.5))
    known = counted.where("word != '' and t + c >= 2").select("word", odds.alias("odds"), z.alias("z")).orderBy(F.desc(F.abs("z")), "word").limit(VOCABULARY).toPandas()
    telling = np.where(known["z"] > 1.2, known["odds"], np.clip(known["odds"], -1, 1)).astype(float)
    strength = {w: s for w, s, zz in zip(known["word"], telling, known["z"], strict=True) if zz > 1.2}

    def draw(batches):
        for batch in batches:
            out = []
            for k, t, y in zip(batch["__key"].tolist(), batch["__text"].tolist(), batch["__label"].tolist(), strict=True):
                words = words_of(t)
                many = [words[s : s + WINDOW] for s in window_starts(len(words))]
                told = [max((strength.get(w, 0.0) for w in ws), default=0.0) for ws in many]
                order = sorted(range(len(many)), key=lambda i: (-told[i], i))
                if y == 1:
                    take = [i for i in order[:WINDOWS_A_ROW] if told[i] >= 0.6 * told[order[0]] and told[i] > 0]
                else:
                    take = order[:1] + [zlib.crc32(f"{k}/{j}".encode()) % len(many) for j in range(WINDOWS_A_ROW - 1)] if many else []
                out += [(k, y, i, many[i]) for i in sorted(set(take))]
            yield pd.DataFrame(out, columns=["key", "label", "at", "words"])

    got = source.mapInPandas(draw, "key string, label int, at long, words array<string>").toPandas()
    release(source)
    if not len(got):
        return None
    got = got.assign(joined=got["words"].map(" ".join)).sort_values(["key", "label", "at", "joined"])
    return fit([list(w) for w in got["words"]], got["label"].to_numpy(), known["word"].tolist(), telling)


class _Scorer:
    def __init__(self, model: ToxicityModel | None):
        self.model = model
        self.code: dict[str, int] = {}
        self.table = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), NOTHING)
        return np.concatenate([self._scores(texts[lo:hi]) for lo, hi in chunks(texts, 600_000)]) if texts else np.zeros(0)

    def _scores(self, texts) -> np.ndarray:
        split = [words_of(t) for t in texts]
        flat = [w for ws in split for w in ws]
        if len(self.code) > CACHE_WORDS:
            self.code, self.table = {}, None
        new = list(set(flat).difference(self.code))
        if new:
            made = self.model.inputs(new)
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            self.table = made if self.table is None else np.concatenate([self.table, made])
        code = np.fromiter(map(self.code.__getitem__, flat), dtype=np.int64, count=len(flat))
        n = np.array([len(ws) for ws in split])
        base = np.cumsum(n) - n
        starts = [window_starts(x) for x in n.tolist()]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        at = np.array([x for s in starts for x in s], dtype=np.int64) + base[owner]
        stop = (base + n)[owner]
        worst = np.full(len(texts), -np.inf)
        for lo in range(0, len(at), 2048):
            place = at[lo : lo + 2048, None] + np.arange(WINDOW)
            mask = place < stop[lo : lo + 2048, None]
            gates = self.table[code[np.minimum(place, len(code) - 1)]]
            np.maximum.at(worst, owner[lo : lo + 2048], self.model.logits(gates, mask).astype(np.float64))
        return np.where(n > 0, _sigmoid(worst), NOTHING)


def score_documents(docs: DataFrame, model: ToxicityModel | None, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the toxicity score of each whole text; only texts go to Python."""
    kept = [c for c in (keep or docs.columns) if c != out]
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(held.value)
        for batch in batches:
            yield pd.Series(scorer.scores(batch.tolist()), dtype="float64")

    return docs.select(*kept, score(F.col(text)).alias(out))
