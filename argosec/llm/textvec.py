"""Text kernels over Arrow string buffers: a batch is one flat byte array, never a list of Python strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1_000_000
_BYTE_MUL = 0x9E3779B97F4A7C15 | 1
_TOKEN_MUL = 0xD1B54A32D192ED03 | 1
_CACHE: dict = {}


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of splitmix64, vectorised."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(mul: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mul**i and its inverse modulo 2**64 for i < n; kept between calls."""
    have = _CACHE.get(mul)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for m in (mul, pow(mul, -1, 2**64)):
            a = np.ones(size, U64)
            a[1:] = U64(m)
            out.append(np.multiply.accumulate(a))
        _CACHE[mul] = have = tuple(out)
    return have


def byte_table() -> np.ndarray:
    if "bytes" not in _CACHE:
        _CACHE["bytes"] = mix64(np.arange(256, dtype=U64), 7)
    return _CACHE["bytes"]


def class_table() -> np.ndarray:
    """0 white space, 1 letters, digits, underscore and every byte of a multi-byte character, 2 other signs."""
    if "class" not in _CACHE:
        t = np.full(256, 2, np.uint8)
        t[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
        for a, b in ((48, 58), (65, 91), (97, 123), (95, 96), (128, 256)):
            t[a:b] = 1
        _CACHE["class"] = t
    return _CACHE["class"]


def flat(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; a null counts as an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not (pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type)):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 4096):
    """Row ranges of at most `limit` bytes and `rows` rows each; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, a + rows)
        yield a, b
        a = b


class Tokens:
    """Tokens of some rows: starts, ends (bytes), row_of, first (first token of each row, and the end), kind, hash."""

    __slots__ = ("starts", "ends", "first", "kind", "hash", "n_rows")

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows, dtype=np.int64), np.diff(self.first))


def tokenize(data: np.ndarray, offsets: np.ndarray, by_space: bool) -> Tokens:
    """by_space: words are maximal runs of non-space; else runs of one class (words, or signs)."""
    t = Tokens()
    n = len(data)
    t.n_rows = len(offsets) - 1
    cls = class_table()[data]
    if by_space:
        np.minimum(cls, 1, out=cls)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    if n:
        np.not_equal(cls[1:], cls[:-1], out=edge[1:n])
        edge[offsets[:-1][offsets[:-1] < n]] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    kind = cls[starts] if n else np.zeros(0, np.uint8)
    keep = kind > 0
    t.starts, t.ends, t.kind = starts[keep], ends[keep], kind[keep]
    up, down = powers(_BYTE_MUL, n + 1)
    acc = np.zeros(n + 1, U64)
    np.cumsum(byte_table()[data] * up[:n], out=acc[1:])
    t.hash = mix64((acc[t.ends] - acc[t.starts]) * down[t.starts])
    t.first = np.searchsorted(t.starts, offsets)
    return t


def count_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of maximal runs of non-space bytes in each row."""
    word = class_table()[data] > 0
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begin[at] = word[at]
    return np.diff(np.concatenate(([0], np.cumsum(begin)))[offsets])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens from each position on; of len(hashes) - k + 1 positions."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    up, down = powers(_TOKEN_MUL, n + 1)
    acc = np.zeros(n + 1, U64)
    np.cumsum(hashes * up[:n], out=acc[1:])
    return mix64((acc[k:] - acc[:-k]) * down[: n - k + 1], k)


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each window of w; by doubling."""
    span, out = 1, a
    while span * 2 <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def i64(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


class HashIndex:
    """Open addressing over distinct 64-bit keys that are hashes already; build and look-up are vectorised."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(1.5 * len(keys) + 1).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.keys, self.values = keys, values
        self.slot = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        at = keys & self.mask
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # of several rivals the last one stays
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + U64(1)) & self.mask

    def find(self, q: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(q), -1, np.int32)
        at = q & self.mask
        out = self.slot[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != q))
        at = at[todo]
        while len(todo):
            at = (at + U64(1)) & self.mask
            s = self.slot[at]
            hit = (s < 0) | (self.keys[s] == q[todo])
            out[todo[hit]] = s[hit]
            todo, at = todo[~hit], at[~hit]
        return out

    def get(self, q: np.ndarray, default):
        r = self.find(q)
        return np.where(r >= 0, self.values[r], self.values.dtype.type(default)) if len(self.values) else np.full(len(q), default, np.float32)
