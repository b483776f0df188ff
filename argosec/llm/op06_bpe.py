"""BPE encoding and decoding with a pair occurrence index.

The vocabulary is a public one given by path (tiktoken rank file); nothing is trained. Texts
are split by the tokenizer's pattern; the distinct pieces of an Arrow batch are laid out as one
linked list of bytes, and an index maps each mergeable pair to all its positions. Ranks that
occur are applied in ascending order from a heap: all positions of the rank merge at once, and
only the lists of the pairs next to them are updated. A piece's ids then go to each of its places.

Defined results: a null text gives null ids, an empty text an empty array; texts of any length are encoded whole; invalid UTF-8 cannot
occur in a string column; special tokens' strings are ordinary text; repeated rows are encoded
each; of equal pairs the leftmost merges first; extra columns stay, and a column named as an output is replaced by the output; an empty table
gives an empty result. Decoding: null ids give a null text, no ids an empty one; an id that is null, negative or not in the vocabulary
gives the replacement character U+FFFD, as do bytes that are no UTF-8.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosec.llm.shared import keep, lean
from argosec.llm.textvec import flat

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BATCH_BYTES = 1 << 22
KEPT_PIECES = 300_000


class Bpe:
    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(PATTERN).findall
        size = max(self.rank.values()) + 1
        self.bytes = [b""] * size
        for k, v in self.rank.items():
            self.bytes[v] = k
        self.byte_id = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        # pairs of tokens that join to a token: key left * size + right
        self.size = size
        keys, ranks = [], []
        for k, v in self.rank.items():
            for cut in range(1, len(k)):
                a, b = self.rank.get(k[:cut]), self.rank.get(k[cut:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    ranks.append(v)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = np.array(keys, np.int64)[order], np.array(ranks, np.int32)[order]
        lens = np.array([len(b) for b in self.bytes], np.int64)
        self.start, self.len = np.cumsum(lens) - lens, lens
        self.pool = np.frombuffer(b"".join([*self.bytes, "\ufffd".encode()]), np.uint8)
        self.start, self.len = np.append(self.start, len(self.pool) - 3), np.append(lens, 3)  # number `size`: no token
        self.forget()

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        out = np.empty(len(left), np.int32)
        for a in range(0, len(left), 1 << 16):  # by steps, as numbers of pairs take 8 bytes
            key = left[a : a + (1 << 16)].astype(np.int64) * self.size + right[a : a + (1 << 16)]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            out[a : a + (1 << 16)] = np.where(self.pair_key[at] == key, self.pair_rank[at], -1)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each)."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(lens.sum())
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        end = np.cumsum(lens)
        place = np.int32 if n < 2**31 - 1 else np.int64
        nxt = np.arange(1, n + 1, dtype=place)
        nxt[end[lens > 0] - 1] = n  # n: none
        prv = np.arange(-1, n - 1, dtype=place)
        prv[(end - lens)[lens > 0]] = -1
        nxt, prv = np.append(nxt, place(n)), np.append(prv, place(-1))
        ids = np.append(ids, np.int32(-1))
        alive = np.ones(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(pos: np.ndarray) -> None:
            """Enter positions whose token and next token may merge."""
            pos = pos[nxt[pos] < n]
            r = self.ranks_of(ids[pos], ids[nxt[pos]])
            ok = r >= 0
            pos, r = pos[ok], r[ok]
            if not len(pos):
                return
            order = np.argsort(r, kind="stable")
            pos, r = pos[order], r[order]
            cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            for rank, part in zip(r[cut].tolist(), np.split(pos, cut[1:])):
                have = index.get(rank)
                if have is None:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)
                else:
                    have.append(part)

        add(np.arange(n, dtype=place))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            pos = pos[alive[pos]]
            pos = pos[nxt[pos] < n]
            if not len(pos):
                continue
            pos = np.unique(pos[self.ranks_of(ids[pos], ids[nxt[pos]]) == rank])
            if not len(pos):
                continue
            if len(pos) > 1:  # runs such as aaaa: leftmost first, no overlap
                linked = np.concatenate(([False], nxt[pos[:-1]] == pos[1:]))
                if linked.any():
                    run = np.cumsum(~linked)
                    nth = np.arange(len(pos)) - np.flatnonzero(~linked)[run - 1]
                    pos = pos[nth % 2 == 0]
            right = nxt[pos]
            alive[right] = False
            ids[pos] = rank
            after = nxt[right]
            nxt[pos] = after
            prv[after] = pos
            prv[n] = -1
            before = prv[pos]
            add(np.unique(np.concatenate((before[before >= 0], pos))))
        alive[n] = False
        got = np.flatnonzero(alive)
        count = np.bincount(np.searchsorted(end, got, "right"), minlength=len(pieces))
        return ids[got], count

    def forget(self) -> None:
        """Pieces seen so far, with their ids; kept over the batches of a worker up to KEPT_PIECES."""
        self.number: dict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        if len(self.number) > KEPT_PIECES:
            self.forget()
        known = len(self.number)
        size = np.zeros(len(texts), np.int64)
        place = []
        for i, x in enumerate(texts):
            if x:
                got = self.find(x)
                size[i] = len(got)
                place.append(np.fromiter(map(self.number.__getitem__, got), np.int32, len(got)))
        place = np.concatenate(place) if place else np.zeros(0, np.int32)
        ids, count = self.encode_pieces([p.encode() for p in islice(self.number, known, None)])
        self.ids, self.count = np.concatenate((self.ids, ids.astype(np.int32))), np.concatenate((self.count, count.astype(np.int32)))
        first = np.cumsum(self.count, dtype=np.int32) - self.count
        count = self.count[place]
        out = gather(self.ids, first[place], count)
        total = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))[np.cumsum(size)]
        return out, np.diff(total, prepend=0)

    def known(self, ids: np.ndarray) -> np.ndarray:
        """ids with the number of U+FFFD for those that are not in the vocabulary."""
        return np.where((ids >= 0) & (ids < self.size), np.where(self.len[np.clip(ids, 0, self.size - 1)] > 0, ids, self.size), self.size)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        return gather(self.pool, self.start[ids], self.len[ids])


def gather(pool: np.ndarray, first: np.ndarray, count: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Concatenation of pool[first:first + count] over all pairs, by steps of so many pairs."""
    out = []
    for a in range(0, len(first), step):
        f, c = first[a : a + step], count[a : a + step]
        begin = np.cumsum(c) - c
        out.append(pool[np.arange(int(c.sum())) + np.repeat(f - begin, c)])
    return np.concatenate(out) if out else pool[:0]


def bpe(path: str) -> Bpe:
    return keep("bpe", "bpe", path, lambda: Bpe(path))


def _pieces_of(batch, limit: int = BATCH_BYTES):
    """Slices of a batch of about `limit` bytes of its last column."""
    size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(size, (size[a - 1] if a else 0) + limit)) + 1
        yield batch.slice(a, b - a)
        a = min(b, batch.num_rows)


def _encode(path: str, names: list[str], verify: bool):
    def run(batches):
        model = bpe(path)
        for batch in batches:
            for b in _pieces_of(batch):
                text = b.column(b.num_columns - 1)
                ids, n = model.encode(text.to_pylist())
                null = np.asarray(text.is_null())
                off = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(off, mask=np.append(null, False)) if null.any() else pa.array(off), pa.array(ids))
                cols = [*b.columns[:-1], tokens, pa.array(n, mask=null)]
                if verify:
                    data, begin = flat(text)
                    size = np.concatenate(([0], np.cumsum(model.len[ids])))[off]
                    back = model.decode(ids)
                    same = np.diff(size) == np.diff(begin)
                    if same.all():
                        differ = np.concatenate(([0], np.cumsum(back != data)))
                        same = differ[begin[1:]] == differ[begin[:-1]]
                    cols.append(pa.array(same, mask=null))
                yield pa.RecordBatch.from_arrays(cols, [*names, *("tokens", "n_tokens", "round_trip")[: 2 + verify]])

    return run


def _decode(path: str, names: list[str]):
    def run(batches):
        model = bpe(path)
        for batch in batches:
            many = pa.compute.fill_null(pa.compute.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
            ends, a = np.cumsum(many.astype(np.int64)), 0
            while a < batch.num_rows:  # a slice of some ids at a time, or one longer row
                z = min(batch.num_rows, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (BATCH_BYTES >> 2))) + 1)
                b = batch.slice(a, z - a)
                t = b.column(b.num_columns - 1)
                ids = model.known(pa.compute.fill_null(t.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64))
                size = np.concatenate(([0], np.cumsum(model.len[ids])))[np.concatenate(([0], np.cumsum(many[a:z])))]
                raw = model.decode(ids).tobytes()
                null = np.asarray(t.is_null())
                text = [None if n else raw[i:j].decode("utf-8", "replace") for i, j, n in zip(size[:-1].tolist(), size[1:].tolist(), null.tolist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string())], [*names, "decoded"])
                a = z

    return run


def _schema(df: DataFrame, names: list[str], more: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*(f"`{n}` {kinds[n]}" for n in names), more])


def encode(docs: DataFrame, ranks: str = RANKS, drop_text: bool = False, verify: bool = False) -> DataFrame:
    """docs with tokens (array<int>) and n_tokens of the column text; no shuffle.

    With verify also round_trip: whether the decoded bytes are the bytes of the text.
    """
    new = ("tokens", "n_tokens", "round_trip")[: 2 + verify]
    names = [c for c in docs.columns if c not in new and not (drop_text and c == "text")]
    use = docs.select(*(F.col(f"`{c}`") for c in names), F.col("text").cast("string").alias("__text"))
    return use.mapInArrow(lean("bpe", _encode(ranks, names, verify)), _schema(docs, names, "tokens array<int>, n_tokens long" + ", round_trip boolean" * verify))


def decode(tokens: DataFrame, ranks: str = RANKS) -> DataFrame:
    """tokens with the column decoded: the text of the ids in the column tokens."""
    names = [c for c in tokens.columns if c != "decoded"]
    use = tokens.select(*(F.col(f"`{c}`") for c in names), F.col("tokens").cast("array<int>").alias("__ids"))
    return use.mapInArrow(lean("bpe", _decode(ranks, names)), _schema(tokens, names, "decoded string"))
