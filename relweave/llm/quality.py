"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Every pair of a preferred (label 1) and a rejected (label 0) document is a comparison; the strength of a document is
linear in its text features, so a pair's chance is the logistic function of the feature difference. ``fit`` draws a
fixed number of pairs (seeded) and minimises the logistic loss with an L2 penalty by Newton's method. The threshold is
a quantile of the strengths of all labelled documents: the share of rejected ones; it is mapped to the score 0.3.

Features are counts of the whole text alone: characters by kind, words, repetition, and the worst block of 64 words.

Defined results: null counts as an empty text, which has all features 0; rows whose label or key is null are not
learned from; without both labels every score is 0.5; repeated rows get equal scores; an empty table gives an empty
table; other columns are no inputs, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.shingles import chunks, shingle_hashes, word_hashes
from relweave.runtime import materialize, release

#: Labelled documents that a model is fitted on at most, the first by a hash of their key.
TRAIN_ROWS = 20_000
PAIRS = 200_000
#: Labels (tens of bytes each) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
THRESHOLD = 0.3
BLOCK = 64

# character kinds: 0 other, 1 lower, 2 upper, 3 digit, 4 sentence marks, 5 exclamation, 6 symbols, 7 bar, 8 line end, 9 space, 10 beyond ASCII
_KIND = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate([b"", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:?'\"()-", b"!", b"#$%&*+/<=>@[\\]^_`{}~", b"|", b"\n", b" \t\r\x0b\x0c", bytes(range(128, 256))]):
    _KIND[list(_chars)] = _k
_KINDS = 11


def _segments(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each segment; empty segments have 0."""
    total = np.r_[0, np.cumsum(values)]
    return total[ends] - total[np.r_[0, ends[:-1]]]


def features(texts: list[str | None]) -> np.ndarray:
    """A row of numbers for each whole text."""
    return np.concatenate([_features(texts[lo:hi]) for lo, hi in chunks(texts, 500_000)]) if texts else np.zeros((0, len(NAMES)))


NAMES = [
    "log_chars", "log_words", "word_length", "upper", "digit", "mark", "exclaim", "symbol", "bar", "lines", "beyond_ascii", "other",
    "distinct_words", "echo", "distinct_threes", "top_upper", "top_symbol", "top_exclaim", "top_bar", "top_echo",
]


def _features(texts: list[str | None]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = _KIND[np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raw])
    doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))
    count = np.bincount(doc * _KINDS + data[: len(doc)], minlength=len(texts) * _KINDS).reshape(-1, _KINDS).astype(float)
    words, word_end = word_hashes(texts)
    n = np.diff(np.r_[0, word_end]).astype(float)
    chars, some = np.array([len(t) if t else 0 for t in texts], dtype=float), np.maximum(n, 1)
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    owner = np.repeat(np.arange(len(texts)), n.astype(np.int64))
    threes, three_end = shingle_hashes(words, word_end, 3)
    echo = np.r_[False, (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])] if len(words) else np.zeros(0, dtype=bool)
    out = [
        np.log1p(chars), np.log1p(n), chars / some, count[:, 2] / letters, count[:, 3] / np.maximum(chars, 1), count[:, 4] / some,
        count[:, 5] / some, count[:, 6] / some, count[:, 7] / some, count[:, 8] / some, count[:, 10] / np.maximum(chars, 1), count[:, 0] / some,
        _distinct(words, word_end) / some, _segments(echo.astype(float), word_end) / some, _distinct(threes, three_end) / np.maximum(np.diff(np.r_[0, three_end]), 1),
    ]
    # the worst block of words
    inside = ~np.isin(data, (8, 9))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, stops = edge[::2], edge[1::2]
    m = min(len(starts), len(words))
    place = np.arange(len(words)) - np.repeat(word_end - n.astype(np.int64), n.astype(np.int64))
    new = np.r_[True, (place[1:] % BLOCK == 0) | (owner[1:] != owner[:-1])] if len(words) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    sizes = np.diff(np.r_[at, len(words)])
    for of in (2, 6, 5, 7):
        total = np.r_[0, np.cumsum(data == of)]
        per_word = np.minimum((total[stops[:m]] - total[starts[:m]]).astype(float), 8.0)
        out.append(_top(np.r_[per_word, np.zeros(len(words) - m)], at, sizes, owner, len(texts)))
    out.append(_top(echo.astype(float), at, sizes, owner, len(texts)))
    return np.stack(out, axis=1)


def _distinct(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, dtype=bool)
    return np.bincount(d[keep], minlength=len(ends)).astype(float)


def _top(per_word: np.ndarray, at: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The largest mean over a text's blocks (blocks of under 16 words count as 16)."""
    out = np.zeros(n)
    if len(at):
        np.maximum.at(out, owner[at], np.add.reduceat(per_word, at) / np.maximum(sizes, 16))
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -10, 10) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``THRESHOLD`` at the quantile cut."""
        if not self.weight.any():
            return np.full(len(x), 0.5)
        z = self.strength(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, seed: int = 7) -> QualityModel:
    """Strengths from preference pairs by Newton's method."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    width = x.shape[1]
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -10, 10)
    rng = np.random.default_rng(seed)
    d = z[good[rng.integers(0, len(good), pairs)]] - z[bad[rng.integers(0, len(bad), pairs)]]
    w = np.zeros(width)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # the chance given to the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(width), d.T @ p / pairs - penalty * w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    return QualityModel(mean, scale, w, float(np.quantile(strength, len(bad) / len(label), method="midpoint")))


def train(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel:
    """A model from the labelled documents for whose key the condition ``learn(column)`` holds.

    Weights come from at most ``rows`` of them, the threshold from the strengths of all.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & learn(F.col(key))).select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).distinct()
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(rows)  # at most `rows` rows of two numbers: safe to broadcast
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    # of rows that repeat a key one is learned from: a bounded number of rows reaches the driver
    source = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch["id"], "label": batch["label"], "x": list(features(batch["text"].tolist()))})

    got = source.select(F.col("id").cast("string"), "label", "text").mapInPandas(run, "key string, label int, x array<double>").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort((*x.T, got["label"].to_numpy(), got["key"].to_numpy()))
    model = fit(x[order], got["label"].to_numpy()[order])
    if not model.weight.any():
        return model
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return replace(model, cut=_cut(texts.join(F.broadcast(known) if few else known, "id").select("label", _per_text(model.strength)("text").alias("strength"))))


def _cut(labelled: DataFrame) -> float:
    """The strength that as large a share of the rows lies below as is rejected: the middle between its neighbours."""
    held = materialize(labelled, "quality")
    share = held.agg(F.avg(1 - F.col("label"))).first()[0]
    below = held.agg(F.percentile_approx("strength", F.lit(float(share)), F.lit(1_000_000))).first()[0]
    above = held.where(F.col("strength") > below).agg(F.min("strength")).first()[0]
    release(held)
    return below if above is None else (below + above) / 2


def _per_text(of):
    """A column function of texts: ``of`` (features, a row a text, to numbers). Only texts go to Python."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(of(features(batch.tolist())), dtype="float64")

    return run


def score_documents(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the score of each whole text."""
    kept = [c for c in (keep or docs.columns) if c != out]
    return docs.select(*kept, _per_text(model.score)(F.col(text)).alias(out))
