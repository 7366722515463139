"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

``PieceModel`` reads a SentencePiece BPE model file. ``encode_words`` holds the symbols of many words in flat numpy
arrays; each round finds the best-ranked adjacent pair of every word (a segmented minimum), merges it in all words at
once and compacts the arrays, until no word has a pair left.

Exactness. The library pops pairs by (score, leftmost). Words (a run of U+2581 and what follows it) never merge with
each other because no piece has U+2581 after another character. Within a word, all places of the best pair are merged
together only where no pair with the new piece can score as well as or better than it; otherwise only the leftmost.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; texts of any
length are encoded whole; repeated rows give repeated results; extra columns are kept unless a result has their name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Words whose pieces a Python worker remembers; the memory starts anew when full.
CACHE_WORDS = 250_000
#: Words encoded together, so that the flat arrays stay in a core's cache.
WORDS_AT_ONCE = 12_000
CHARS_AT_ONCE = 3_000_000
NO_PAIR = 1 << 60


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in one array; where each part begins; its size."""
    size = np.array([len(x) for x in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(size) - size, size


class PieceModel:
    """A SentencePiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("a BPE model with the identity normaliser and kept white space is needed")
        kinds = {p.type for p in proto.pieces}
        if kinds - {1, 2, 3, 6} or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined and unused pieces and suffix white space are not supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.byte_id = np.full(256, -1, dtype=np.int64)
        self.piece_bytes: list[bytes] = []
        normal: dict[str, int] = {}
        score: dict[int, float] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.piece_bytes.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 1:
                normal[p.piece], score[i] = i, p.score
                self.piece_bytes.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.piece_bytes.append(b"" if p.type == 3 else " ⁇ ".encode())
        if (self.byte_id < 0).any():
            raise ValueError("the model lacks byte pieces")
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece has white space after another character")
        decimals = [b"%d," % i for i in range(len(self.pieces))]
        self.decimal, self.decimal_start, self.decimal_size = _flat(decimals)
        self.blob, self.blob_start, self.blob_size = _flat(self.piece_bytes)
        # symbols: piece ids, then one id for each character that only occurs inside longer pieces
        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, len(self.pieces) + len(symbol) - len(normal))
        self.char_symbol = {c: s for c, s in symbol.items() if len(c) == 1}
        self.symbol_char = {s: c for c, s in self.char_symbol.items()}
        self.n_symbols = len(self.pieces) + len(symbol) - len(normal)
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        left, right, made = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        left, right, made = (np.array(x, dtype=np.int64) for x in (left, right, made))
        rank = np.array([order[score[i]] for i in made], dtype=np.int64)
        piece_rank = np.full(self.n_symbols, 1 << 30, dtype=np.int64)
        piece_rank[made] = rank
        self.unsafe = np.zeros(self.n_symbols, dtype=bool)
        for part in (left, right):
            self.unsafe[part[rank <= piece_rank[part]]] = True
        self._table(left * self.n_symbols + right, made, rank)
        inner = {c for p in normal if len(p) > 1 for c in p}
        #: Characters that no longer piece has stand alone and so end a word.
        self.alone = "".join(c for c in "\n\t\r" if c not in inner)
        stop = re.escape(self.alone)
        self.words = re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+" + (f"|[{stop}]" if stop else ""))

    def _table(self, key, made, rank) -> None:
        """Open addressing: pair -> (rank, piece); probed for all pairs at once."""
        bits = max(4, int(np.ceil(np.log2(len(key) * 4 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.value = np.zeros(1 << bits, dtype=np.int64)
        pending, at = np.arange(len(key)), self._slot(key)
        self.probes = 0
        while len(pending):
            self.probes += 1
            free = self.keys[at] < 0
            self.keys[at[free]] = key[pending[free]]
            placed = self.keys[at] == key[pending]
            self.value[at[placed]] = (rank[pending] << 20 | made[pending])[placed]
            pending, at = pending[~placed], (at[~placed] + 1) & self.mask

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(rank << 20 | merged piece) of each pair; a huge number where the pair is no piece."""
        key = a.astype(np.int64) * self.n_symbols + b
        at, out = self._slot(key), np.full(len(key), NO_PAIR, dtype=np.int64)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == key[open_]
            out[open_[hit]] = self.value[at[hit]]
            more = ~hit & (held >= 0)
            if not more.any():
                break
            open_, at = open_[more], (at[more] + 1) & self.mask
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's ids begin and end, by merge rounds over all words."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars, inverse = np.unique(point, return_inverse=True)
        known = np.array([self.char_symbol.get(chr(c), -1 - int(c)) for c in chars], dtype=np.int64)
        symbol = known[inverse] if len(point) else np.zeros(0, dtype=np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        value = self._at(symbol, word, np.arange(len(symbol)))
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(value, starts)
            lengths = np.diff(np.r_[starts, len(symbol)])
            best = np.repeat(best, lengths)
            done = best >= NO_PAIR
            if done.any():  # words without a pair leave
                finished.append((word[done], symbol[done]))
                symbol, word, value, best = (x[~done] for x in (symbol, word, value, best))
                if not len(symbol):
                    break
            # the places of the best rank; ties of score between pieces count as one rank
            place = np.flatnonzero(value >> 20 == best >> 20)
            owner = word[place]
            first = np.r_[True, owner[1:] != owner[:-1]]
            piece = value[place] & 0xFFFFF
            single = np.zeros(len(words), dtype=bool)
            single[owner[self.unsafe[piece]]] = True
            # runs of touching places (aaa): merge every second one, from the left
            touch = np.r_[False, np.diff(place) == 1] & ~first
            at = np.arange(len(place))
            offset = at - np.maximum.accumulate(np.where(touch, 0, at))
            take = np.where(single[owner], first, offset % 2 == 0)
            place, piece = place[take], piece[take]
            symbol[place] = piece
            keep = np.ones(len(symbol), dtype=bool)
            keep[place + 1] = False
            symbol, word, value = symbol[keep], word[keep], value[keep]
            # only pairs beside a merge change
            changed = place - np.arange(len(place))
            at = np.concatenate([changed, changed[changed > 0] - 1])
            value[at] = self._at(symbol, word, at)
        word, symbol = (np.concatenate([x[i] for x in finished]) if finished else np.zeros(0, dtype=np.int64) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        odd = np.flatnonzero((symbol < 0) | (symbol >= len(self.pieces)))
        if len(odd):  # characters that are no piece become bytes
            made = [self._bytes(int(x)) for x in symbol[odd]]
            count = np.ones(len(symbol), dtype=np.int64)
            count[odd] = [len(x) for x in made]
            is_odd = np.zeros(len(symbol), dtype=bool)
            is_odd[odd] = True
            symbol, word, is_odd = np.repeat(symbol, count), np.repeat(word, count), np.repeat(is_odd, count)
            symbol[is_odd] = [b for x in made for b in x]
        return symbol, np.searchsorted(word, np.arange(len(words) + 1))

    def _at(self, symbol, word, at):
        out = np.full(len(at), NO_PAIR, dtype=np.int64)
        ok = at + 1 < len(symbol)
        ok[ok] = (word[at[ok]] == word[at[ok] + 1]) & (symbol[at[ok]] >= 0) & (symbol[at[ok] + 1] >= 0)
        left = at[ok]
        out[ok] = self.pairs(symbol[left], symbol[left + 1])
        return out

    def _bytes(self, symbol: int) -> list[int]:
        if symbol >= 0:
            c = self.symbol_char[symbol]
        else:
            c = chr(-1 - symbol)
        return [int(self.byte_id[b]) for b in c.encode("utf-8", "replace")]

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.words.findall((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))

    def encode(self, text: str | None) -> list[int]:
        words = self.split(text or "")
        return self.encode_words(words)[0].tolist() if words else []

    def decode(self, ids: list[int]) -> str:
        out = b"".join([self.piece_bytes[i] for i in ids])
        if self.dummy_prefix and ids and self.pieces[ids[0]].startswith(SPACE):
            out = out[1:]
        return out.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


class WordMemory:
    """The ids of words seen before, in one flat array; starts anew after ``CACHE_WORDS`` words."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a list of words one after another, and each word's number of ids."""
        if len(self.code) > CACHE_WORDS:
            self.clear()
        new = list(set(words).difference(self.code))
        ids, ends = [self.ids], [self.ends]
        for lo in range(0, len(new), WORDS_AT_ONCE):
            symbol, at = self.model.encode_words(new[lo : lo + WORDS_AT_ONCE])
            ids.append(symbol.astype(np.int32))
            ends.append(at[1:] + ends[-1][-1])
        if new:
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            self.ids, self.ends = np.concatenate(ids), np.concatenate(ends)
        code = np.fromiter(map(self.code.__getitem__, words), dtype=np.int64, count=len(words))
        start, size = self.ends[code], np.diff(self.ends)[code]
        return self.ids[_ranges(start, size)], size


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHARS_AT_ONCE`` characters."""
    lo = chars = 0
    for i, t in enumerate(texts):
        chars += len(t) if t else 0
        if chars >= CHARS_AT_ONCE:
            yield lo, i + 1
            lo, chars = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _encoded(texts: list[str | None], memory: WordMemory) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of chunks of rows, and where each row's ids end."""
    for lo, hi in _chunks(texts):
        split = [memory.model.split(t) if t else [] for t in texts[lo:hi]]
        ids, size = memory.ids_of([w for words in split for w in words])
        words_end = np.cumsum([len(words) for words in split])
        yield ids, np.r_[0, np.cumsum(size)][words_end]


def _digests(model: PieceModel, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, str, str]]:
    """For each row: number of ids, SHA-256 of its decimal ids joined by commas, SHA-256 of its decoded text in UTF-8."""
    decimal = np.frombuffer(model.decimal[_ranges(model.decimal_start[ids], model.decimal_size[ids])], dtype=np.uint8)
    decoded = model.blob[_ranges(model.blob_start[ids], model.blob_size[ids])]
    decimal_end = np.r_[0, np.cumsum(model.decimal_size[ids])][ends].tolist()
    decoded_end = np.r_[0, np.cumsum(model.blob_size[ids])][ends].tolist()
    decimal, decoded, ends = decimal.tobytes(), decoded.tobytes(), ends.tolist()
    out, lo, d_lo, t_lo = [], 0, 0, 0
    for hi, d_hi, t_hi in zip(ends, decimal_end, decoded_end, strict=True):
        skip = int(model.dummy_prefix and hi > lo and model.pieces[ids[lo]].startswith(SPACE))
        text = decoded[t_lo + skip : t_hi]
        out.append((hi - lo, hashlib.sha256(decimal[d_lo : max(d_lo, d_hi - 1)]).hexdigest(), hashlib.sha256(text).hexdigest()))
        lo, d_lo, t_lo = hi, d_hi, t_hi
    return out


def encode_documents(df: DataFrame, model_path: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``out`` array<int>, the ids of the whole text; ``decode_documents`` undoes it."""
    kept = [c for c in (keep or df.columns) if c != out]
    source = df.select(*kept, F.col(text).alias("__text"))

    def run(batches):
        memory = WordMemory(load_model(model_path))
        for batch in batches:
            ids = [x for flat, ends in _encoded(batch["__text"].tolist(), memory) for x in np.split(flat, ends[:-1])]
            yield batch.drop(columns="__text").assign(**{out: ids})

    schema = df.select(*kept).schema.add(out, T.ArrayType(T.IntegerType()))
    return source.mapInPandas(run, schema)


def decode_documents(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text that ``ids`` stand for (null: empty)."""
    kept = [c for c in df.columns if c != out]

    def run(batches):
        model = load_model(model_path)
        for batch in batches:
            yield batch[kept].assign(**{out: [model.decode([] if x is None else list(x)) for x in batch[ids].tolist()]})

    return df.select(*kept).mapInPandas(run, df.select(*kept).schema.add(out, "string"))


def token_digests(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the decoded text) of each row."""

    def run(batches):
        memory = WordMemory(load_model(model_path))
        for batch in batches:
            rows = [r for flat, ends in _encoded(batch["__text"].tolist(), memory) for r in _digests(memory.model, flat, ends)]
            n, ids, decoded = zip(*rows, strict=True) if rows else ([], [], [])
            yield pd.DataFrame({key: batch[key], "n_tokens": np.array(n, dtype=np.int64), "ids_sha256": list(ids), "decoded_sha256": list(decoded)})

    schema = df.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return df.select(key, F.col(text).alias("__text")).mapInPandas(run, schema)
