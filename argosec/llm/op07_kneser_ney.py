"""Quality classifier: interpolated modified Kneser-Ney trigram model of trusted text.

Tokens are lower-cased words and runs of signs. Every trusted document (labelled quality 1 and toxic 0) is used once, by a hash of its
doc_id: one half of them is counted, all of it, and the other gives the thresholds, as a document that was counted itself
looks less surprising than it is. (`max_train_docs`, if given, bounds the counted ones of each language.) Each task counts the trigrams of
some COUNT_TOKENS tokens and sends them, as packed places in a list of their words, to the range of hashes of their first bigram, where counts, and the totals and
kinds of what follows each bigram, are whole; then, when those shuffle files are gone, once more to the range of their last bigram, for continuation counts. The
model holds whole numbers, of which a worker works out shares and back-off weights for the n-grams it asks for. A shard is a range of hashes of SHARD_ROWS trigrams
at most on average, written as plain columns to the shared folder, and removed once all is scored. Scoring looks the n-grams of
a block of documents (BLOCK_TOKENS tokens, or one longer document) up in the shards one after the other. Shards on a local file system are mapped into
memory, so that a block costs what its own n-grams take, however large the model; from others a shard is read whole for each block, and a model of up to
KEPT_ROWS n-grams is kept in the worker. All give the same perplexities.

A document is rejected when its mean surprisal, less `slack` / sqrt(tokens), exceeds the
`quantile` of that figure among the trusted documents that were not counted, of its own language;
a language (or null) with fewer than `least` such documents takes the quantile over all of them.
The quantiles cover every document of that half.

Defined results: a null, empty or token-less text has perplexity null and keep false; texts of any length are scored whole; a null
lang is a language of its own; repeated rows are scored and kept each; a score equal to the threshold is kept; extra columns are left alone;
an empty table gives an empty result; with no trusted rows the model is uniform and, as there is
no threshold, every document that has tokens is kept. A row's decision follows from its text and lang alone, so rows of a
null or repeated doc_id are judged each; a doc_id, an integer, only ties rows to labels (what cannot be read as one counts as null),
and a doc_id with contradicting labels is not trusted.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosec.llm.shared import drop_path, drop_stash, keep, lean, new_path, stash, worker_fs
from argosec.llm.textvec import _TOKEN_MUL, chunks, flat, mix64, tokenize
from argosec.storage import release_shuffles, write_text

MAX_TRAIN_DOCS = None  # no bound
QUANTILE, SLACK, LEAST = 0.998, 5.0, 50
SHARD_ROWS, KEPT_ROWS, BLOCK_TOKENS, COUNT_TOKENS = 250_000, 2_000_000, 700_000, 1_000_000
PIECE_BYTES = 250_000  # of text that are cut into tokens at once
SHARD_BYTES = 5  # of text for each trigram of a shard, at least
RANGE_BITS = 16  # of a key that name its range
TABLES = {1: ("",), 2: ("bi",), 3: ("tri", "ctx")}
COUNTS = ("n", "total", "n1", "n2", "n3")


def _pack(*cols: np.ndarray) -> bytes:
    """Columns of whole numbers of one length: each in the fewest bytes of 1, 2, 4 or 8, by planes of bytes, compressed."""
    out = [np.array([len(cols[0]), len(cols)], np.int64).tobytes()]
    for c in cols:
        c = c.view(np.uint64) if c.dtype.itemsize == 8 else c.astype(np.uint64)
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(c) or int(c.max()) < 1 << 8 * w)
        planes = c.view(np.uint8).reshape(len(c), 8).T[:width]
        out += [bytes([width]), planes.tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    """The columns of _pack."""
    raw = np.frombuffer(pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little")), np.uint8)
    (n, k), at, out = raw[:16].view(np.int64).tolist(), 16, []
    for _ in range(k):
        width = int(raw[at])
        planes = raw[at + 1 : at + 1 + n * width].reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"u{width}"))
        at += 1 + n * width
    return out


def _gram(*words: np.ndarray) -> np.ndarray:
    """Hash of these words in a row, as textvec.grams has it; column by column, without tables of powers as long as the text."""
    acc = words[-1]
    for w in words[-2::-1]:
        acc = acc * np.uint64(_TOKEN_MUL)
        acc += w
    return mix64(acc, len(words))


def _tri(two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """Key of a trigram: the upper bits of its first bigram's hash, so that both lie in one range, and the rest from its own hash."""
    low = np.uint64(RANGE_BITS)
    return (two >> (np.uint64(64) - low) << (np.uint64(64) - low)) | (three >> low)


def _range(key: np.ndarray, n: int) -> np.ndarray:
    """Which of n even ranges a hash lies in."""
    return ((key >> np.uint64(64 - RANGE_BITS)) * np.uint64(n)) >> np.uint64(RANGE_BITS)


def _by_range(key: np.ndarray) -> np.ndarray:
    """An order of hashes by range, for any number of ranges: their upper bits are sorted with their places in the lower ones, which takes less than argsort."""
    low = np.uint64(max(20, len(key).bit_length()))
    both = np.sort((key >> low << low) | np.arange(len(key), dtype=np.uint64))
    return (both & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int32)


def _first(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and where in it each distinct key begins."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)


def _cuts(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, from, to) of a column in order."""
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else np.zeros(1, np.int64)
    return [(int(group[a]), int(a), int(z)) for a, z in zip(at, at[1:])]


def _count_grams(shards: int, groups: int, ends: bool):
    """(grp, words, data) of some documents: their distinct trigrams with counts to the group of their first bigram; with `ends`, without counts to the group of their last one, and the words to groups of their own."""

    def count(hashes, sizes):
        h, n = np.concatenate(hashes), np.concatenate(sizes)
        hashes.clear()
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        ok = np.flatnonzero(row[2:] == row[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
        del row
        got = []
        u, v, w = h[ok], h[ok + 1], h[ok + 2]
        order, at = _first(_tri(_gram(u, v), _gram(u, v, w)))
        of, times = order[at], np.diff(np.append(at, len(order)))
        del ok, order, at
        cols = u[of], v[of], w[of]
        del u, v, w, of
        grp = _range(_gram(*cols[ends : ends + 2]), shards) * np.uint64(groups) // np.uint64(shards)
        order = np.argsort(grp, kind="stable")
        for g, a, z in _cuts(grp[order]):
            i = order[a:z]
            names, at = np.unique(np.concatenate([c[i] for c in cols]), return_inverse=True)
            x, y, t = at.reshape(3, -1)
            by = np.lexsort((t, y, x))
            data = _pack(x[by], y[by], t[by], *(() if ends else (times[i][by],)))
            got.append((g, False, len(data).to_bytes(8, "little") + data + _pack(names)))
        if ends:
            word = np.unique(h)
            got += [(g, True, _pack(word[a:z])) for g, a, z in _cuts(_range(word, groups))]
        return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int32(), pa.bool_(), pa.binary()))], ["grp", "words", "data"])

    def run(batches):
        hashes, sizes, held = [], [], 0
        for b in batches:
            for _, h, n in _tokens(b):
                hashes.append(h)
                sizes.append(n)
                held += len(h)
                if held >= COUNT_TOKENS:
                    yield count(hashes, sizes)
                    hashes, sizes, held = [], [], 0
        if held:
            yield count(hashes, sizes)

    return run


def _counted(batches, cols: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(columns of the trigrams, words) of all that was counted for a group."""
    found, own = [[np.zeros(0, np.uint64)] for _ in range(cols)], [np.zeros(0, np.uint64)]
    for b in batches:
        for words, data in zip(b.column(1).to_pylist(), b.column(2)):
            data = data.as_py()
            if words:
                own.append(_unpack(data)[0])
                continue
            n = int.from_bytes(data[:8], "little")
            got, names = _unpack(data[8 : 8 + n]), _unpack(data[8 + n :])[0].astype(np.uint64)
            for k, c in enumerate(got):
                found[k].append(names[c] if k < 3 else c.astype(np.uint64))
    return [np.concatenate(c) for c in found], own


def _rows(path: str, parts: dict[int, dict], more: dict):
    """A file of plain columns, each of whole numbers in the fewest bytes of 1, 2, 4 or 8 from a multiple of 8 on, and a row a shard that tells where those of its tables are: (place, bytes a number, numbers). The first row has `more`."""
    fs, bare = worker_fs(path)
    rows, name, at = [], uuid.uuid4().hex, 0
    if parts:
        fs.create_dir(f"{bare}/data", recursive=True)
        with fs.open_output_stream(f"{bare}/data/{name}", compression=None) as f:
            for s in sorted(parts):
                places = {}
                for table, cols in parts[s].items():
                    for c in cols:
                        width = 8 if c.dtype == np.uint64 else next(w for w in (1, 2, 4, 8) if w == 8 or int(c.max(initial=0)) < 1 << 8 * w)
                        raw = c.astype(f"u{width}").tobytes()
                        f.write(raw + b"\0" * (-len(raw) % 8))
                        places.setdefault(table, []).append((at, width, len(c)))
                        at += len(raw) + -len(raw) % 8
                rows.append({"shard": s, "file": name, "at": json.dumps(places)})
    rows = rows or [{}]
    rows[0] |= more
    yield from (pa.RecordBatch.from_pylist([r], schema=_ARROW) for r in rows)


def _by_shard(shards: int, tables: dict) -> dict[int, dict]:
    """shard -> table -> columns, of tables whose first column are keys in order."""
    parts: dict[int, dict] = {}
    for name, cols in tables.items():
        for s, a, z in _cuts(_range(cols[0], shards)):
            parts.setdefault(s, {})[name] = [c[a:z] for c in cols]
    return parts


def _contexts(path: str, shards: int):
    """Trigrams and their counts, and what follows each of their first bigrams."""

    def run(batches):
        (u, v, w, n), _ = _counted(batches, 4)
        uv = _gram(u, v)
        tri = _tri(uv, _gram(u, v, w))
        del u, v, w
        order, at = _first(tri)
        tri, uv, n = tri[order[at]], uv[order[at]], np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        order, at = _first(uv)
        ctx = (uv[order[at]], *_follow(n[order], at))
        yield from _rows(path, _by_shard(shards, {"tri": (tri, n), "ctx": ctx}), {"stats": [*_first_counts(n), len(tri) + len(at)]})

    return run


def _ends(path: str, shards: int):
    """Bigrams that end a trigram, by the number of different words before them; words as the end of bigrams, as what they begin with, and all there are."""

    def run(batches):
        (u, v, w), own = _counted(batches, 3)
        of = np.unique(_tri(_gram(u, v), _gram(u, v, w)), return_index=True)[1]
        v, w = v[of], w[of]
        vw = _gram(v, w)
        order, at = _first(vw)
        bi, m, v, w = vw[order[at]], np.diff(np.append(at, len(order))), v[order[at]], w[order[at]]
        end, ends = np.unique(w, return_counts=True)
        order, at = _first(v)
        begin, follow = v[order[at]], _follow(m[order], at)
        words = np.unique(np.concatenate([*own, end, begin]))
        cols = [np.zeros(len(words), np.int64) for _ in COUNTS]
        cols[0][np.searchsorted(words, end)] = ends
        for c, x in zip(cols[1:], follow):
            c[np.searchsorted(words, begin)] = x
        yield from _rows(path, _by_shard(shards, {"bi": (bi, m)}), {"word": _pack(words, *cols), "stats": [*_first_counts(m), len(bi)]})

    return run


_SHARD = "shard int, file string, at string, word binary, stats array<bigint>"
_ARROW = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("at", pa.string()), ("word", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _first_counts(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def _follow(n: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Total of the counts n of each run that begins at `at`, and how many of them are 1, 2, and 3 or more."""
    return [np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for x in (n, n == 1, n == 2, n > 2)]


def _word_rows(batches):
    for b in batches:
        for data in b.column(0):
            cols = _unpack(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.uint64).view(np.int64)), *(pa.array(c.astype(np.int64)) for c in cols[1:])], ["word", *COUNTS])


def _words(path: str):
    """The words of a partition, in order, as a shard."""

    def run(batches):
        cols = [np.concatenate(c) for c in zip(*([c.to_numpy() for c in b.columns] for b in batches))]
        yield from _rows(path, {0: {"": [cols[0].view(np.uint64), *cols[1:]]}} if cols else {}, {})

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def fit(trusted: DataFrame) -> str:
    """Train on the column text of a table; returns the folder of the model."""
    spark = trusted.sparkSession
    text = trusted.select(F.col("text").cast("string").alias("text"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(1 << RANGE_BITS, max(1, -(-size // (SHARD_ROWS * SHARD_BYTES))))
    groups = -(-shards // 2)
    path, stats, shard = new_path(spark, "kneser-ney"), {}, {}

    def write(df: DataFrame, k: int) -> DataFrame:
        release_shuffles(spark, lambda: df.write.option("compression", "uncompressed").parquet(f"{path}/{k}"))
        made = spark.read.schema(_SHARD).parquet(f"{path}/{k}")
        shard[k] = sorted((r.shard, r.file, json.loads(r.at)) for r in made.where("file is not null").select("shard", "file", "at").collect())  # a row a shard
        return made

    for k, make in ((3, _contexts), (2, _ends)):  # one after the other, so that only one of the shuffles is on disk
        counted = text.mapInArrow(lean("kneser-ney", _count_grams(shards, groups, k == 2)), "grp int, words boolean, data binary").repartitionById(groups, "grp")
        made = write(counted.mapInArrow(lean("kneser-ney", make(path, shards)), _SHARD), k)
        stats[k] = [x or 0 for x in made.agg(*(F.sum(F.col("stats")[i]) for i in range(5))).first()]
    words = made.where("word is not null").select("word").mapInArrow(lean("kneser-ney", _word_rows), ", ".join(f"{c} long" for c in ("word", *COUNTS)))
    uni = stash(words.groupBy("word").agg(F.greatest(F.sum("n"), F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in COUNTS[1:])), "words")
    of = uni.agg(F.count("*"), F.sum("n"), *(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first()
    n = max(1, -(-of[0] // SHARD_ROWS))
    part = F.least(F.lit(n - 1), ((F.col("word") / 2.0**64 + 0.5) * n).cast("int"))  # words are hashes, so ranges of them are even
    write(uni.repartitionById(n, part).sortWithinPartitions("word").select("word", *COUNTS).mapInArrow(lean("kneser-ney", _words(path)), _SHARD), 1)
    drop_stash(uni)
    d = {1: _discounts(*of[2:]), **{k: _discounts(*x[:4]) for k, x in stats.items()}}
    held = sum(c * x for c, x in zip((of[2], of[3], of[0] - of[2] - of[3]), d[1]))
    meta = {"shards": shards, "words": of[0], "rows": of[0] + sum(x[4] for x in stats.values()), "total": of[1] or 0, "floor": (held / of[1] if of[0] else 1.0) / (of[0] + 1), "discounts": d, "shards_at": shard}
    write_text(spark, f"{path}/model.json", json.dumps(meta))
    return path


class Model:
    """The shards of each order, looked into one after the other: mapped into memory from a local file system until close(), else read each time. All are kept while they have no more than KEPT_ROWS rows.

    Order 1 is the words in order, as they end bigrams (n) and as what follows them adds up (total, n1, n2, n3). A shard of orders 2 and 3 is a range of hashes
    of bigrams: as the end of trigrams (order 2); what follows a bigram, and the trigrams that begin with it (order 3).
    """

    def __init__(self, path: str):
        self.fs, self.bare = worker_fs(path)
        with self.fs.open_input_stream(f"{self.bare}/model.json") as h:
            meta = json.loads(h.read())
        self.n_shards, self.total, self.floor = meta["shards"], meta["total"], meta["floor"]
        self.discounts = {int(k): np.array([0.0, *d]) for k, d in meta["discounts"].items()}
        self.at = {int(k): rows for k, rows in meta["shards_at"].items()}
        self.files = {k: sorted({file for _, file, _ in rows}) for k, rows in self.at.items()}
        self.keep = meta["rows"] <= KEPT_ROWS
        self.maps: dict[str, np.ndarray] = {}
        self.held: dict[tuple[str, int, str], tuple] = {}
        if self.keep:
            for k, tables in TABLES.items():
                for table in tables:
                    list(self.shards(k, table))

    def shards(self, k: int, table: str = ""):
        """Order 1: (words in order, n, total, n1, n2, n3). Orders 2 and 3: (shard, (keys in order, and the other columns of one of its tables))."""
        for s, file, at in self.at[k]:
            if table not in at:
                continue
            got = self.held.get((file, s, table))
            if got is None:
                got = self._columns(file, at[table])
                if k == 1:
                    got = (got[0].view(np.int64), *got[1:])
                if self.keep:
                    got = self.held[file, s, table] = tuple(c.copy() for c in got)
            yield got if k == 1 else (s, got)

    def _columns(self, file: str, places: list) -> tuple[np.ndarray, ...]:
        path, first = f"{self.bare}/data/{file}", 0
        if isinstance(self.fs, pafs.LocalFileSystem):
            if file not in self.maps:
                with pa.memory_map(path) as h:
                    self.maps[file] = np.frombuffer(h.read_buffer(), np.uint8)
            raw = self.maps[file]
        else:
            first, last = places[0][0], places[-1][0] + places[-1][1] * places[-1][2]
            with self.fs.open_input_file(path) as h:
                raw = np.frombuffer(h.read_at(last - first, first), np.uint8)
        return tuple(raw[a - first : a - first + w * n].view(f"u{w}") for a, w, n in places)

    def close(self) -> None:
        """Let go of the mapped files: while they are mapped, removing them frees no disk."""
        self.maps.clear()

    def words(self, h: np.ndarray) -> list[np.ndarray]:
        """Share of each word, total of what follows it, and its back-off weight; 0 of those that are not known."""
        q = h.view(np.int64)
        order = np.argsort(q).astype(np.int32)
        q = q[order]
        out = [np.zeros(len(q), np.float32) for _ in range(3)]
        for own, n, *follow in self.shards(1):
            if len(own):
                lo, hi = np.searchsorted(q, own[0]), np.searchsorted(q, own[-1], "right")
                to, i = _hits(lo, q[lo:hi], own)
                out[0][to] = self._share(1, n[i], self.total)
                out[1][to], out[2][to] = self._follow(2, [c[i] for c in follow])
        return [_back(order, x) for x in out]

    def find(self, k: int, table: str, q: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        """Of each key, by a merge with each shard: of ends of trigrams (bi) and of trigrams (tri) the discounted number, of contexts (ctx) the total of what follows and the back-off weight; 0 if not known. order: that of _by_range."""
        q = q[order]
        of = _range(q, self.n_shards).astype(np.int32)
        out = [np.zeros(len(q), np.float32) for _ in range(1 + (table == "ctx"))]
        for s, own in self.shards(k, table):
            lo, hi = np.searchsorted(of, [s, s + 1])
            if lo < hi:
                to, i = _hits(lo, q[lo:hi], own[0])
                if table == "ctx":
                    out[0][to], out[1][to] = self._follow(3, [c[i] for c in own[1:]])
                else:
                    out[0][to] = self._share(k, own[1][i], 1)
        return [_back(order, x) for x in out]

    def log2(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Log probability of each token given the two before it in its row."""
        share, total, back = self.words(h)
        p = share + self.floor
        if len(h) > 1:
            two = _gram(h[:-1], h[1:])
            lower = p[1:]
            ok = (row[1:] == row[:-1]) & (total[:-1] > 0)
            by = _by_range(two)
            (ends,) = self.find(2, "bi", two, by)
            p[1:] = np.where(ok, ends / np.maximum(total[:-1], 1).astype(np.float64) + back[:-1] * lower, lower)
            del share, ends, total, back, lower
            total, back = self.find(3, "ctx", two, by)
            del by
            ok = np.flatnonzero((row[2:] == row[:-2]) & (total[:-1] > 0)).astype(np.int32)
            if len(ok):
                key = _tri(two[ok], _gram(h[ok], h[ok + 1], h[ok + 2]))
                del two
                (count,) = self.find(3, "tri", key, _by_range(key))
                p[ok + 2] = count / total[ok].astype(np.float64) + back[ok] * p[ok + 2]
        return np.log2(p)

    def _share(self, k: int, n: np.ndarray, total) -> np.ndarray:
        return (n - self.discounts[k][np.minimum(n, 3)]) / max(total, 1)

    def _follow(self, k: int, follow: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Total and back-off weight of contexts, from the total and the numbers of counts 1, 2, and 3 or more."""
        total, *n = follow
        return total, sum(x * d for x, d in zip(n, self.discounts[k][1:])) / np.maximum(total, 1)


def _back(order: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x in the order before it was sorted."""
    out = np.empty_like(x)
    out[order] = x
    return out


def _hits(lo: int, keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places from lo on of those keys that a table in order has, and their rows in it."""
    if not len(keys) or not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    hit = np.flatnonzero(own[i] == keys)
    return lo + hit, i[hit]


def model(path: str) -> Model:
    return keep("kneser-ney", "model", path, lambda: Model(path))


def _tokens(batch):
    """(slice, tokens' hashes, number of tokens of each row) of a batch's last column, by slices of about PIECE_BYTES."""
    text = batch.column(batch.num_columns - 1)
    for a, z in chunks(flat(text)[1], PIECE_BYTES):
        t = tokenize(*flat(pc.utf8_lower(text.slice(a, z - a))), by_space=False)
        yield batch.slice(a, z - a), t.hash, np.diff(t.first)


def _blocks(batches):
    """Batches cut or joined so that each has about BLOCK_TOKENS tokens of the last column: (batch, tokens' hashes, first token of each row)."""
    held, hashes, sizes, n = [], [], [], 0
    for b in batches:
        for part, h, size in _tokens(b):
            held.append(part)
            hashes.append(h)
            sizes.append(size)
            n += len(h)
            if n >= BLOCK_TOKENS:
                block = held, np.concatenate(hashes), np.concatenate(sizes)
                held, hashes, sizes, n = [], [], [], 0
                yield block
                del block
    if held:
        yield held, np.concatenate(hashes), np.concatenate(sizes)


def _score(path: str, drop: int):
    """The columns but the last `drop` ones, with the tokens and the surprisal of the last column."""

    def run(batches):
        m = model(path)
        try:
            for held, h, n in _blocks(batches):
                row = np.repeat(np.arange(len(n), dtype=np.int32), n)
                total = np.bincount(row, m.log2(h, row), minlength=len(n))
                at = 0
                for b in held:
                    k, s = n[at : at + b.num_rows], total[at : at + b.num_rows]
                    at += b.num_rows
                    cols = b.columns[: b.num_columns - drop]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(k), pa.array(-s / np.maximum(k, 1), mask=k == 0)], [*b.schema.names[: len(cols)], "__n_tokens", "__surprisal"])
        finally:
            m.close()

    return run


def perplexity(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, lang, n_tokens, surprisal) of every row; surprisal is in bits a token."""
    use = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return use.mapInArrow(lean("kneser-ney", _score(path, 1)), "doc_id long, lang string, __n_tokens long, __surprisal double").withColumnsRenamed({"__n_tokens": "n_tokens", "__surprisal": "surprisal"})


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int | None = MAX_TRAIN_DOCS) -> tuple[str, DataFrame, DataFrame]:
    """Folder of the model; (doc_id) of trusted documents and of those of them it was fitted on: a half, without bound unless max_train_docs is given."""
    good = labels.groupBy(F.col("doc_id").try_cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id")
    pick = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).join(good, "doc_id").distinct()
    pick = stash(pick.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)), "trusted")
    half = pick.where("u < 0.5")
    if max_train_docs is not None:
        size = pick.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))
        near = half.join(F.broadcast(size), F.col("lang").eqNullSafe(F.col("l"))).where(F.col("u") < 2.0 * max_train_docs / F.col("n"))  # a row a language
        first = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))  # over some 2 * max_train_docs rows a language
        half = near.withColumn("r", first).where(F.col("r") <= max_train_docs)
    sample = stash(half.select("doc_id").distinct(), "sample")
    text = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("text")
    return fit(text), pick.select("doc_id").distinct(), sample


def judge(scored: DataFrame, trusted: DataFrame, sample: DataFrame, quantile: float, slack: float, least: int) -> DataFrame:
    """scored (__id, __lang, __n_tokens, __surprisal and more) with __limit and __keep."""
    scored = scored.withColumn("__s", F.col("__surprisal") - slack / F.sqrt("__n_tokens"))
    held = scored.select("__id", "__lang", "__s").where("__s is not null").join(trusted, F.col("__id") == trusted["doc_id"], "left_semi").join(sample, F.col("__id") == sample["doc_id"], "left_anti")
    at = F.percentile_approx("__s", F.lit(quantile), F.lit(100_000))  # rank error 1e-5
    by = held.groupBy("__lang").agg(at.alias("__own"), F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("__lang").alias("__l"), "__own")
    out = scored.join(F.broadcast(by), F.col("__lang").eqNullSafe(F.col("__l")), "left").crossJoin(F.broadcast(held.agg(at.alias("__whole"))))  # a row a language, and one row
    out = out.withColumn("__limit", F.coalesce("__own", "__whole"))
    return out.withColumn("__keep", F.col("__n_tokens").cast("boolean") & F.coalesce(F.col("__s") <= F.col("__limit"), F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame, max_train_docs: int | None = MAX_TRAIN_DOCS, quantile: float = QUANTILE, slack: float = SLACK, least: int = LEAST) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, keep) for each row of docs."""
    path, trusted, sample = train(docs, labels, max_train_docs)
    scored = perplexity(docs, path).withColumnsRenamed({"doc_id": "__id", "lang": "__lang", "n_tokens": "__n_tokens", "surprisal": "__surprisal"})
    scored = stash(scored, "perplexity")
    drop_path(docs.sparkSession, path)
    out = judge(scored, trusted, sample, quantile, slack, least)
    return out.select(F.col("__id").alias("doc_id"), F.col("__lang").alias("lang"), F.col("__n_tokens").alias("n_tokens"), F.pow(F.lit(2.0), "__surprisal").alias("perplexity"), F.col("__limit").alias("threshold"), F.col("__keep").alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train_docs: int | None = MAX_TRAIN_DOCS, quantile: float = QUANTILE, slack: float = SLACK, least: int = LEAST) -> DataFrame:
    """docs without the rejected rows. The rows are scored and written with all their columns, so texts are neither shuffled nor joined."""
    path, trusted, sample = train(docs, labels, max_train_docs)
    x = docs.withColumns({"__id": F.col("doc_id").try_cast("long"), "__lang": F.col("lang").cast("string"), "__text": F.col("text").cast("string")})
    names = [c for c in x.columns if c != "__text"]
    use = x.select(*(F.col(f"`{c}`") for c in names), "__text")
    kinds = {f.name: f.dataType.simpleString() for f in use.schema.fields}
    same = docs.schema["text"].dataType.simpleString() == "string"  # then the text needs to travel only once
    names = [c for c in names if not (same and c == "text")]
    use = use.select(*(F.col(f"`{c}`") for c in names), "__text")
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*names, *["__text"] * same]), "__n_tokens long", "__surprisal double"])
    scored = stash(use.mapInArrow(lean("kneser-ney", _score(path, 0 if same else 1)), schema), "scored")
    drop_path(docs.sparkSession, path)
    out = judge(scored, trusted, sample, quantile, slack, least).where("__keep")
    return out.select(*(F.col("__text").alias("text") if same and c == "text" else F.col(f"`{c}`") for c in docs.columns))
