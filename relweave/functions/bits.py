"""Bit strings, least significant bit first within each byte, with an account of where every bit went."""

from __future__ import annotations

import numpy as np

CATEGORIES = ("payload", "relation", "header", "framing", "crc", "leftover", "prefix", "sideinfo")


def bits_from_bytes(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")


def bytes_from_bits(bits: np.ndarray) -> bytes:
    if len(bits) % 8:
        raise ValueError("the number of bits is no multiple of 8")
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def bits_to_bytes_ceil(n_bits: int) -> int:
    return -(-n_bits // 8)


def int_bits(value: int, width: int) -> np.ndarray:
    """``value`` in ``width`` bits; raises where it does not fit (nothing is masked off)."""
    if value < 0 or value >> width:
        raise ValueError(f"{value} does not fit {width} bits")
    return bits_from_bytes(value.to_bytes(bits_to_bytes_ceil(width), "little"))[:width]


def zigzag(value: int) -> int:
    return 2 * value if value >= 0 else -2 * value - 1


def unzigzag(code: int) -> int:
    return code // 2 if code % 2 == 0 else -(code + 1) // 2


#: Groups of 7 bits that a reader accepts in one variable-length number.
MOST_GROUPS = 11


def varint_bytes(value: int) -> bytes:
    """Zigzag, then groups of 7 bits, lowest first, the high bit set on all but the last."""
    code, out = zigzag(value), bytearray()
    while True:
        out.append(code & 0x7F | (0x80 if code > 0x7F else 0))
        code >>= 7
        if not code:
            break
    if len(out) > MOST_GROUPS:
        raise ValueError("the number is too large for a variable-length field")
    return bytes(out)


#: Bytes that are spread to one byte a bit at a time.
PIECE_BYTES = 1 << 18


class BitWriter:
    """Collects fields as packed bytes, each under a category; ``finish`` pads to a byte (framing) and checks the account.

    Only ``PIECE_BYTES`` at a time take a byte a bit, so a writer needs about the size of what it has written.
    """

    def __init__(self):
        self.out = bytearray()
        self.open = np.zeros(0, dtype=np.uint8)  # bits of the last byte while it is not full
        self.account = dict.fromkeys(CATEGORIES, 0)

    def bits(self, bits: np.ndarray, category: str) -> None:
        bits = np.asarray(bits, dtype=np.uint8).ravel()
        self.account[category] += bits.size
        for lo in range(0, bits.size, 8 * PIECE_BYTES):
            piece = np.concatenate([self.open, bits[lo : lo + 8 * PIECE_BYTES]])
            full = piece.size - piece.size % 8
            self.out += np.packbits(piece[:full], bitorder="little").tobytes()
            self.open = piece[full:]

    def number(self, value: int, width: int, category: str) -> None:
        self.bits(int_bits(value, width), category)

    def raw(self, data: bytes, category: str) -> None:
        if not self.open.size:
            self.out += data
            self.account[category] += 8 * len(data)
            return
        for lo in range(0, len(data), PIECE_BYTES):
            self.bits(bits_from_bytes(data[lo : lo + PIECE_BYTES]), category)

    def varint(self, value: int, category: str) -> None:
        self.raw(varint_bytes(value), category)

    def finish(self) -> tuple[bytes, dict[str, int]]:
        self.bits(np.zeros(-self.open.size % 8, dtype=np.uint8), "framing")
        data = bytes(self.out)
        self.out = bytearray()
        if sum(self.account.values()) != 8 * len(data):
            raise AssertionError("the account does not add up to the container's size")
        return data, {f"{k}_bits": v for k, v in self.account.items()}


def merge_accounts(*accounts: dict[str, int]) -> dict[str, int]:
    """The sum of several accounts, by category."""
    return {c: sum(a.get(c, 0) for a in accounts) for c in dict.fromkeys(k for a in accounts for k in a)}


class BitReader:
    """Reads fields of a bit string; only the field in hand takes a byte a bit."""

    def __init__(self, data: bytes):
        self.data, self.n = data, 8 * len(data)
        self.at = 0

    def bits(self, n: int) -> np.ndarray:
        if n < 0 or self.at + n > self.n:
            raise EOFError("the bit string ends early")
        first = self.at // 8
        out = bits_from_bytes(self.data[first : -(-(self.at + n) // 8)])[self.at - 8 * first :][:n]
        self.at += n
        return out

    def number(self, width: int) -> int:
        got = self.bits(width)
        return int.from_bytes(np.packbits(got, bitorder="little").tobytes(), "little")

    def raw(self, n: int) -> bytes:
        if n < 0 or self.at + 8 * n > self.n:
            raise EOFError("the bit string ends early")
        if self.at % 8 == 0:
            self.at += 8 * n
            return bytes(self.data[self.at // 8 - n : self.at // 8])
        out = bytearray()
        for lo in range(0, n, PIECE_BYTES):
            out += np.packbits(self.bits(8 * min(PIECE_BYTES, n - lo)), bitorder="little").tobytes()
        return bytes(out)

    def varint(self) -> int:
        code = 0
        for group in range(MOST_GROUPS):
            byte = self.number(8)
            code |= (byte & 0x7F) << 7 * group
            if byte < 0x80:
                return unzigzag(code)
        raise ValueError("a variable-length number does not end")

    def align(self) -> None:
        self.bits(-self.at % 8)

    @property
    def remaining(self) -> int:
        return self.n - self.at


def reshape(data: bytes, width: int, offset: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, prefix, leftover): ``offset`` bits are skipped, then rows of ``width`` bits; what is left over is shorter than a row."""
    if width < 1 or not 0 <= offset < width:
        raise ValueError("the width must be positive and the offset below it")
    bits = bits_from_bytes(data)
    prefix, rest = bits[:offset], bits[offset:]
    n = len(rest) // width
    return rest[: n * width].reshape(n, width), prefix, rest[n * width :]


def row_pieces(data: bytes, width: int, offset: int = 0):
    """The matrix of ``reshape`` in pieces of at most about 8 * PIECE_BYTES bits."""
    n = max(0, 8 * len(data) - offset) // width
    step = max(1, 8 * PIECE_BYTES // width)
    for lo in range(0, n, step):
        m, at = min(step, n - lo), offset + lo * width
        bits = bits_from_bytes(data[at // 8 : -(-(at + m * width) // 8)])[at % 8 :][: m * width]
        yield bits.reshape(m, width)


def pack_rows(matrix: np.ndarray) -> np.ndarray:
    """0/1 rows to little-endian 64-bit words: bit j of a row is bit j % 64 of word j // 64."""
    n, width = matrix.shape
    words = -(-width // 64)
    padded = np.zeros((n, words * 64), dtype=np.uint8)
    padded[:, :width] = matrix
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").reshape(n, words)


def unpack_rows(words: np.ndarray, width: int) -> np.ndarray:
    data = np.ascontiguousarray(words).view(np.uint8).reshape(len(words), 8 * words.shape[1])
    return np.unpackbits(data, axis=1, bitorder="little")[:, :width]


def table_to_bytes(table: np.ndarray) -> bytes:
    return np.ascontiguousarray(table, dtype="<i8").tobytes()


def bytes_to_table(data: bytes, n_cols: int) -> np.ndarray:
    if len(data) % (8 * n_cols):
        raise ValueError("the bytes are no whole number of rows")
    return np.frombuffer(data, dtype="<i8").reshape(-1, n_cols)
