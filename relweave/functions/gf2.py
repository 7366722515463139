"""Row spaces over GF(2) as mergeable, bounded state: reduced echelon rows, at most one a column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from relweave.functions.bits import pack_rows, unpack_rows


class Echelon:
    """The reduced row echelon form of all rows absorbed so far.

    The form depends on the row space alone, so absorbing is associative, commutative and idempotent, and the echelon
    rows of one state may be absorbed by another. Pivots are leftmost: the lowest bit of a row.
    """

    def __init__(self, width: int):
        self.width, self.words = width, -(-width // 64)
        self.pivots: list[int] = []
        self.rows = np.zeros((0, self.words), dtype=np.uint64)

    def _reduce(self, rows: np.ndarray) -> np.ndarray:
        """Rows with all pivots cleared; eight pivots at a time by a table of their 256 sums."""
        for lo in range(0, len(self.pivots), 8):
            part, mine = self.pivots[lo : lo + 8], self.rows[lo : lo + 8]
            code = np.zeros(len(rows), dtype=np.int64)
            for k, p in enumerate(part):
                code |= ((rows[:, p >> 6] >> np.uint64(p & 63)) & np.uint64(1)).astype(np.int64) << k
            sums = np.zeros((1 << len(part), self.words), dtype=np.uint64)
            for k in range(len(part)):
                sums[1 << k : 2 << k] = sums[: 1 << k] ^ mine[k]
            rows = rows ^ sums[code]
        return rows

    def absorb(self, rows: np.ndarray, at_once: int = 1 << 15) -> None:
        """Add rows (n, words). Most rows vanish under the basis of the rows before; only remainders are eliminated."""
        step = 512
        lo = 0
        while lo < len(rows) and len(self.pivots) < self.width:
            rest = self._reduce(rows[lo : lo + step])
            rest = rest[rest.any(axis=1)]
            lo += step
            step = min(at_once, step * 4)
            while len(rest) and len(self.pivots) < self.width:
                self._insert(rest[:64])
                rest = self._reduce(rest[64:])
                rest = rest[rest.any(axis=1)]

    def _insert(self, rows: np.ndarray) -> None:
        for row in rows:
            at = np.array(self.pivots, dtype=np.int64)
            has = (row[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            row = row ^ np.bitwise_xor.reduce(self.rows[has], axis=0) if has.any() else row
            word = np.flatnonzero(row)
            if not len(word):
                continue
            w = int(word[0])
            low = int(row[w]) & -int(row[w])
            pivot = w * 64 + low.bit_length() - 1
            # the new row clears its pivot from the others
            has = (self.rows[:, w] >> np.uint64(pivot & 63)) & np.uint64(1) == 1
            self.rows[has] ^= row
            at = int(np.searchsorted(self.pivots, pivot))
            self.pivots.insert(at, pivot)
            self.rows = np.insert(self.rows, at, row, axis=0)

    def without_first(self) -> Echelon:
        """The row space with column 0 dropped (its bit cleared in every row)."""
        out = Echelon(self.width - 1)
        if len(self.rows):
            out.absorb(pack_rows(unpack_rows(self.rows, self.width)[:, 1:]))
        return out


@dataclass(frozen=True)
class Basis:
    """A leftmost column basis: every free column is the sum of the pivot columns of its coefficients (and 1 where ``const``)."""

    n_rows: int
    n_cols: int
    pivots: list[int]
    free: list[int]
    coefficients: np.ndarray  # (free, pivots)
    const: np.ndarray  # (free,)
    affine: bool = False

    @property
    def rank(self) -> int:
        return len(self.pivots)

    @property
    def n_relations(self) -> int:
        return len(self.free)

    @property
    def recovered_bits(self) -> int:
        return self.n_rows * self.n_relations

    @property
    def coeff_width(self) -> int:
        return len(self.pivots) + (1 if self.affine and self.n_rows else 0)

    @property
    def description_bits(self) -> int:
        return 96 + self.n_cols + len(self.free) * self.rank

    def masks(self) -> np.ndarray:
        """A row of words for each relation: the free column and its pivots, whose sum is ``const``."""
        m = np.zeros((len(self.free), self.n_cols), dtype=np.uint8)
        m[:, self.pivots] = self.coefficients
        m[np.arange(len(self.free)), self.free] = 1
        return pack_rows(m) if len(m) else np.zeros((0, -(-self.n_cols // 64)), dtype=np.uint64)

    def rebuild(self, pivot_bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(pivot_bits), self.n_cols), dtype=np.uint8)
        out[:, self.pivots] = pivot_bits
        out[:, self.free] = (pivot_bits.astype(np.int64) @ self.coefficients.astype(np.int64).T + self.const) & 1
        return out


def with_ones(matrix: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(matrix), 1), dtype=np.uint8), matrix], axis=1)


def basis_of(state: Echelon, n_rows: int, affine: bool) -> Basis:
    """The basis that a state over rows [1 | A] stands for (affine), or over A."""
    form = unpack_rows(state.rows, state.width).astype(np.uint8)
    if not affine:
        pivots = list(state.pivots)
        free = sorted(set(range(state.width)) - set(pivots))
        return Basis(n_rows, state.width, pivots, free, form[:, free].T, np.zeros(len(free), dtype=np.uint8))
    cols = state.width - 1
    if not n_rows:
        return Basis(0, cols, [], list(range(cols)), np.zeros((cols, 0), dtype=np.uint8), np.zeros(cols, dtype=np.uint8), True)
    pivots = [p - 1 for p in state.pivots[1:]]
    free = sorted(set(range(cols)) - set(pivots))
    at = [f + 1 for f in free]
    return Basis(n_rows, cols, pivots, free, form[1:, at].T, form[0, at], True)


def column_basis(matrix: np.ndarray) -> Basis:
    state = Echelon(matrix.shape[1])
    state.absorb(pack_rows(matrix))
    return basis_of(state, len(matrix), False)


def affine_column_basis(matrix: np.ndarray) -> Basis:
    state = Echelon(matrix.shape[1] + 1)
    state.absorb(pack_rows(with_ones(matrix)))
    return basis_of(state, len(matrix), True)


def holds(matrix: np.ndarray, basis: Basis) -> bool:
    return bool((basis.rebuild(matrix[:, basis.pivots]) == matrix).all())
