"""SimHash near-dedup by anchor-point covering.

Fingerprint: 186 bits (six blocks of 31) of the signs of summed random signs over the *set*
of lower-cased words (letters and digits; punctuation is left out). Two documents match when
at most `max_distance` bits differ.

Every pair is found, by pigeonhole. Up to 2*6-1 = 11 bits: some block differs by at most one. Anchors are the words of the Hamming
code [31,26], a perfect code of covering radius 1; the anchor nearest to the one lies within 1 + 1 of the other, so replicating
each block to every anchor within covering radius plus block threshold (1, or 16 anchors) makes the pair meet. Beyond (24 by default) such balls of
anchors would hold thousands, so the 186 bits are cut into parts (`parts`: 7 of 22 bits and 2 of 16 for 24 bits), of which one of 22 differs by at most 2 bits or
one of 16 by at most 1: else the pair would have 7 * 3 + 2 * 2 = 25 different bits. Parts of 2 meet at a key that either reaches by at most one
flip; flips of the upper bits send a row to other shards, those of the lower ones are done inside the shard. Parts of 1 meet where the differing bit is left out.
Equal fingerprints are folded before they are
replicated, so groups of thousands of copies cost one fingerprint. The members of an anchor or key with more than CELL of them are compared in
cells of two blocks, over all tasks; shards of more than SHARD rows are taken apart by key first. Links are counted in each class of
distinct fingerprints, every pair of them, in cells of at most CELL rows a side.

Defined results: a null, empty or word-less text has no fingerprint and belongs to no group; texts of any length are taken whole;
a document is a row (doc_id, text): equal rows are one document, rows that share a doc_id but not the text are two, and
a null doc_id is an id like others that comes last. Of a group the row of least doc_id is kept, of several of them the one of least row hash.
Extra columns are ignored. An empty table gives an empty result. doc_id is an integer; what cannot be read as one counts as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosec.llm.shared import components, keep, lean, new_path, stash, worker_table
from argosec.llm.textvec import chunks, flat, mix64, tokenize

BLOCKS, BLOCK_BITS = 6, 31
MAX_DISTANCE, CELL = 24, 4096
SHARD, SHARD_OWN, KEY_BITS = 400_000, 16_384, 48
IN_PLACE = 4_000_000  # hashes of rows, 32 MB
PIECE_BYTES = 250_000  # of text that are cut into words at once
_SPREAD: dict = {}


def _spread() -> np.ndarray:
    """Byte -> eight lanes of one byte, each 0 or 1, in a uint64."""
    if "t" not in _SPREAD:
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        _SPREAD["t"] = np.ascontiguousarray(bits).view(np.uint64)[:, 0].copy()
    return _SPREAD["t"]


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 3 uint64, number of distinct words); the top two bits of each word are 0."""
    n = len(offsets) - 1
    out, distinct = np.zeros((n, 3), np.uint64), np.zeros(n, np.int64)
    for a, b in chunks(offsets, PIECE_BYTES):
        lo = offsets[a]
        t = tokenize(data[lo : offsets[b]], offsets[a : b + 1] - lo, by_space=False)
        word = t.kind == 1
        rows = b - a
        shift = np.uint64(52)  # 12 bits of row, 52 of hash: the same whatever shares the chunk
        key = np.sort((t.row_of()[word].astype(np.uint64) << shift) | (t.hash[word] >> np.uint64(12)))
        if not len(key):
            continue
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        row = (key >> shift).astype(np.int64)
        key &= (np.uint64(1) << shift) - np.uint64(1)
        count = np.bincount(row, minlength=rows)
        distinct[a:b] = count
        first = np.concatenate(([0], np.cumsum(count)))
        have = np.flatnonzero(count)
        # reduce at row starts and, as lanes are bytes, after every 255 words
        begin = np.concatenate([np.arange(first[r], first[r + 1], 255) for r in have])
        owner = np.searchsorted(have, row[begin])
        table = _spread()
        for w in range(3):
            h = mix64(key, 11 + w).view(np.uint8).reshape(-1, 8)
            sums = np.stack([np.add.reduceat(table[h[:, j]], begin) for j in range(8)], axis=1)
            lanes = sums.view(np.uint8).reshape(len(begin), 64).astype(np.int64)
            total = np.add.reduceat(lanes, np.searchsorted(owner, np.arange(len(have))), axis=0)
            bits = (2 * total > count[have][:, None]).astype(np.uint8)
            bits[:, 62:] = 0
            out[a + have, w] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out, distinct


def anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): every Hamming [31,26] code word within distance 2 of each 31-bit block."""
    block = block.astype(np.uint64)
    syndrome = np.zeros(len(block), np.int64)
    for i in range(BLOCK_BITS):
        syndrome ^= np.where((block >> np.uint64(i)) & np.uint64(1), i + 1, 0)
    flips = np.zeros((32, 16), np.uint64)  # masks by syndrome; column 0 is the nearest code word
    for s in range(1, 32):
        flips[s, 0] = 1 << (s - 1)
        pairs = sorted({(min(i, i ^ s), max(i, i ^ s)) for i in range(1, 32) if i ^ s})
        flips[s, 1:] = [(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs]
    rows = np.arange(len(block))
    code = syndrome == 0
    many = block[~code, None] ^ flips[syndrome[~code]]
    return np.concatenate((rows[code], np.repeat(rows[~code], 16))), np.concatenate((block[code], many.ravel()))


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _fingerprint_batches(batches):
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            s = b.slice(at, 1000)
            fp, words = fingerprints(*flat(pc.utf8_lower(s.column(2))))
            keep = pa.array(words > 0)
            fp = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), *(pa.array(np.ascontiguousarray(fp[:, i])) for i in range(3))], ["rid", "doc_id", "f0", "f1", "f2"]).filter(keep)


def _replicate(batches):
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            s = b.slice(at, 1000)
            fp = np.stack([s.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1).view(np.uint64)
            rows, keys = [], []
            for j in range(BLOCKS):
                r, a = anchors((fp[:, j // 2] >> np.uint64(31 * (j % 2))) & np.uint64(2**31 - 1))
                rows.append(r)
                keys.append((a << np.uint64(3)) | np.uint64(j))
            r, k = np.concatenate(rows), np.concatenate(keys).view(np.int64)
            t = s.take(pa.array(r))
            yield pa.RecordBatch.from_arrays([pa.array(k), *t.columns], ["anchor", "id", "f0", "f1", "f2"])


def _bucket_edges(ids: np.ndarray, fp: np.ndarray, most: int, step: int = 1024):
    """Edges that connect all matching members of one anchor, in steps of at most step x step comparisons."""
    n = len(ids)
    root = np.arange(n)
    while True:
        low = root.copy()
        for a in range(0, n, step):
            for b in range(0, n, step):
                near = distance(fp[a : a + step, None], fp[None, b : b + step]) <= most
                low[a : a + step] = np.minimum(low[a : a + step], np.where(near, root[None, b : b + step], n).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    member = root != np.arange(n)
    return ids[member], ids[root[member]]


def _by_key(batches, most: int | None = None):
    """(hot, columns) of whole groups; input is sorted by its first column within the partition, and a group may span batches.

    A group that has grown beyond `most` rows is hot: its rows are given as they come, and never held together.
    """
    left, hot = None, None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if hot is not None:
            n = int(np.searchsorted(cols[0], hot, "right"))
            if n:
                yield True, [c[:n] for c in cols]
            cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            hot = None
        if left is not None:
            cols = [np.concatenate(p) for p in zip(left, cols)]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last:
            yield False, [c[:last] for c in cols]
        left = [c[last:] for c in cols]
        if most is not None and len(left[0]) > most:
            yield True, left
            left, hot = None, left[0][0]
    if left is not None:
        yield False, left


_FOUND = "a long, b long, anchor long, id long, f0 long, f1 long, f2 long"


def _found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), *[pa.nulls(len(a), pa.int64())] * 5], [c.split()[0] for c in _FOUND.split(", ")])


def _hot(cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.nulls(len(cols[0]), pa.int64())] * 2, *map(pa.array, cols)], [c.split()[0] for c in _FOUND.split(", ")])


def _near(key: np.ndarray, row: np.ndarray, ids: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all matching rows of each key; keys are in order, row says which of ids and fp each belongs to."""
    out = []
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
    size = np.diff(cut)
    i = np.flatnonzero(np.repeat(size <= 32, size))
    first = np.ascontiguousarray(fp[:, 0])
    for off in range(1, min(32, int(size.max()) if len(size) else 0)):
        i = i[: np.searchsorted(i, len(key) - off)]
        i = i[key[i + off] == key[i]]
        x, y = row[i], row[i + off]
        near = np.bitwise_count(first[x] ^ first[y]) <= most
        x, y = x[near], y[near]
        near = distance(fp[x], fp[y]) <= most
        out.append((ids[x[near]], ids[y[near]]))
    for g in np.flatnonzero(size > 32):
        s = row[cut[g] : cut[g + 1]]
        out.append(_bucket_edges(ids[s], fp[s], most))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def parts(most: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each part: fingerprints that differ by at most `most` bits differ in some part by at most its radius, as radii + 1 sum to most + 1."""
    n = -(-(most + 1) // 3)
    ones = 3 * n - (most + 1)
    two = min(31, int(186 / (n - ones + 0.72 * ones)))  # so that both kinds let about as many chance pairs meet
    one = min(two, (186 - two * (n - ones)) // max(ones, 1))
    out, at = [], 0
    for k in range(n):
        r, bits = (2, two) if k < n - ones else (1, one)
        out.append((at, bits, r))
        at += bits
    return out


def _part(fp: np.ndarray, at: int, bits: int) -> np.ndarray:
    w, s = divmod(at, 62)
    v = fp[:, w] >> np.uint64(s)
    if s + bits > 62:
        v = v | (fp[:, w + 1] << np.uint64(62 - s))
    return v & np.uint64((1 << bits) - 1)


def _high(most: int, n: int) -> list[int]:
    """Upper bits of each part that name its shard: about SHARD_OWN of n rows have a shard as their own."""
    want = max(2, (n // SHARD_OWN).bit_length())
    return [min(want, bits // 2) for _, bits, _ in parts(most)]


def _to_shards(most: int, high: list[int]):
    """Each row to the shards where it may meet others: its own and those one flip away, for a part of radius 2; one for each bit left out, for radius 1."""

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                s = b.slice(start, 1000)
                fp = np.stack([s.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1).view(np.uint64)
                keys = []
                for k, (at, bits, r) in enumerate(parts(most)):
                    v, tag = _part(fp, at, bits), np.uint64(k << KEY_BITS)
                    if r == 2:
                        top = v >> np.uint64(bits - high[k])
                        keys += [tag | top, *(tag | (top ^ np.uint64(1 << i)) for i in range(high[k]))]
                    else:
                        keys += [tag | np.uint64(i << 40) | (v & np.uint64((1 << i) - 1)) | (v >> np.uint64(i + 1) << np.uint64(i)) for i in range(bits)]
                t = s.take(pa.array(np.tile(np.arange(s.num_rows), len(keys))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *t.columns], ["anchor", "id", "f0", "f1", "f2"])

    return run


def _flips(shard: np.ndarray, fp: np.ndarray, most: int, high: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) in order of the keys of rows in their shards."""
    keys, rows = [], []
    of = shard >> KEY_BITS
    for k, (at, bits, r) in enumerate(parts(most)):
        i = np.flatnonzero(of == k)
        if r == 1:
            keys.append(shard[i])
            rows.append(i)
        elif len(i):
            low = bits - high[k]
            v = _part(fp[i], at, bits).view(np.int64)
            here = (v & ((1 << low) - 1)) | (shard[i] & ((1 << high[k]) - 1)) << low | k << KEY_BITS
            own = here == (v | k << KEY_BITS)  # others have spent their flip on the way here
            keys += [here, (here[own, None] ^ (1 << np.arange(low))).ravel()]
            rows += [i, np.repeat(i[own], low)]
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(key, kind="stable")
    return key[order], row[order]


def _compare_shards(most: int, high: list[int], cell: int, shard: int):
    """Edges that connect the matching rows of each key of each shard; rows of keys with more than `cell`, and all of shards with more than `shard` rows, come with their keys."""

    def run(batches):
        for hot, cols in _by_key(batches, shard):
            for a in range(0, len(cols[0]), 10_000) if hot else (0,):
                use = [c[a : a + 10_000] for c in cols] if hot else cols
                if not len(use[0]):
                    continue
                ids, fp = use[1], np.stack(use[2:], axis=1).view(np.uint64)
                key, row = _flips(use[0], fp, most, high)
                cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
                large = np.ones(len(key), bool) if hot else np.repeat(np.diff(cut) > cell, np.diff(cut))
                if large.any():
                    yield _hot([key[large], *(c[row[large]] for c in use[1:])])
                    key, row = key[~large], row[~large]
                a_, b_ = _near(key, row, ids, fp, most)
                e = np.unique(np.stack([np.maximum(a_, b_), np.minimum(a_, b_)], axis=1), axis=0)
                yield _found(e[:, 0], e[:, 1])

    return run


def _compare(most: int, cell: int):
    """Edges (a, b) that connect the matching members of each anchor; the members of an anchor of more than `cell` as they are."""

    def run(batches):
        for hot, cols in _by_key(batches, cell):
            if not hot and len(cols[0]):
                cut = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1], [True])))
                large = np.repeat(np.diff(cut) > cell, np.diff(cut))
                yield from edges([c[~large] for c in cols])
                cols = [c[large] for c in cols]
            if len(cols[0]):
                yield _hot(cols)

    def edges(cols):
        yield _found(*_near(cols[0], np.arange(len(cols[0])), cols[1], np.stack(cols[2:], axis=1).view(np.uint64), most))

    return run


def _links(most: int):
    """Number of fingerprints within `most` bits of each, by cell: all pairs where side is 0 everywhere, else pairs of different sides."""

    def run(batches):
        for _, cols in _by_key(batches):
            key, fid, side, fp = cols[0], cols[1], cols[2], np.stack(cols[3:], axis=1).view(np.uint64)
            n = np.zeros(len(key), np.int64)
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size = np.diff(cut)
            small = np.repeat(size <= 32, size)
            for off in range(1, min(32, int(size.max()))):
                i = np.flatnonzero((key[off:] == key[:-off]) & small[off:] & ((side[off:] != side[:-off]) | (side[off:] == 0)))
                i = i[distance(fp[i], fp[i + off]) <= most]
                np.add.at(n, i, 1)
                np.add.at(n, i + off, 1)
            for g in np.flatnonzero(size > 32):
                s = np.arange(cut[g], cut[g + 1])
                one, two = (s, s) if not side[s].any() else (s[side[s] == 1], s[side[s] == 2])
                for a in range(0, len(one), 512):
                    for b in range(0, len(two), 512):
                        near = distance(fp[one[a : a + 512], None], fp[None, two[b : b + 512]]) <= most
                        n[one[a : a + 512]] += near.sum(axis=1)
                        if two is not one:
                            n[two[b : b + 512]] += near.sum(axis=0)
                if two is one:
                    n[s] -= 1  # itself
            yield pa.RecordBatch.from_arrays([pa.array(fid), pa.array(n)], ["fid", "n"])

    return run


def _cell_edges(most: int):
    """Edges that connect the matching members of each cell."""

    def run(batches):
        for _, cols in _by_key(batches):
            fid, fp = cols[1], np.stack(cols[3:], axis=1).view(np.uint64)
            cut = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1], [True])))
            for x, y in zip(cut, cut[1:]):
                a, b = _bucket_edges(fid[x:y], fp[x:y], most)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return run


def cells(members: DataFrame, group: str, cell: int) -> DataFrame:
    """(key, fid, side, f0, f1, f2) of members (fid, group, f0, f1, f2), sorted by key: a group is cut in blocks of about `cell` rows by a hash, and each pair of blocks, also
    a block with itself (side 0), is a cell. Every pair of members meets in a cell, and no task holds more than one cell."""
    size = members.groupBy(group).agg(F.ceil(F.count("*") / F.lit(float(cell))).cast("int").alias("blocks"))
    x = members.join(size, group).withColumn("block", F.pmod(F.xxhash64("fid", F.lit(7)), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    x = x.select(F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fid", side.alias("side"), "f0", "f1", "f2")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartition(n, "key").sortWithinPartitions("key")


def count_links(members: DataFrame, most: int, cell: int = CELL) -> DataFrame:
    """(fid, n_links) of members (fid, root, f0, f1, f2): fingerprints of the same class within `most` bits."""
    return cells(members, "root", cell).mapInArrow(lean("simhash", _links(most)), "fid long, n long").groupBy("fid").agg(F.sum("n").alias("n_links"))


def edges_at_anchors(reps: DataFrame, max_distance: int, cell: int = CELL, shard: int = SHARD) -> DataFrame:
    """(a, b) of fingerprints (fid, f0, f1, f2): edges that connect all that are at most max_distance bits apart."""
    use, columns = reps.select("fid", "f0", "f1", "f2"), "anchor long, id long, f0 long, f1 long, f2 long"
    partitions = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(rows, compare):
        found = stash(rows.repartition(partitions, "anchor").sortWithinPartitions("anchor").mapInArrow(lean("simhash", compare), _FOUND), "anchors")
        return found.where("a is not null").select("a", "b"), found.where("anchor is not null").select("anchor", "id", "f0", "f1", "f2")

    if max_distance < 2 * BLOCKS:
        edges, hot = meet(use.mapInArrow(lean("simhash", _replicate), columns), _compare(max_distance, cell))
    else:
        high = _high(max_distance, reps.count())
        edges, hot = meet(use.mapInArrow(lean("simhash", _to_shards(max_distance, high)), columns), _compare_shards(max_distance, high, cell, shard))
        if not hot.isEmpty():
            more, hot = meet(hot, _compare(max_distance, cell))
            edges = edges.union(more)
    if hot.isEmpty():
        return edges
    return edges.union(cells(hot.withColumnRenamed("id", "fid"), "anchor", cell).mapInArrow(lean("simhash", _cell_edges(max_distance)), "a long, b long"))


def _row_id(docs: DataFrame):
    """Hash of a document's id and text; null differs from every value."""
    return F.xxhash64(F.to_json(F.struct(F.col("doc_id").cast("string").alias("d"))), F.col("text").cast("string"))


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, group_id, n_links, keep) of every document (a distinct row) that has a near duplicate, and the rid of each row with a fingerprint; both are tables of the shared folder."""
    spark = docs.sparkSession
    use = docs.select(_row_id(docs).alias("rid"), F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    prints = use.mapInArrow(lean("simhash", _fingerprint_batches), "rid long, doc_id long, f0 long, f1 long, f2 long")
    prints = stash(prints.withColumn("fid", F.xxhash64("f0", "f1", "f2")), "prints")
    rows = prints.groupBy("rid", "doc_id", "fid").agg(F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("f2").alias("f2"))
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("at"), "rid", "doc_id")
    reps = stash(rows.groupBy("fid").agg(F.min(order).alias("least"), F.count("*").alias("n"), *(F.first(f).alias(f) for f in ("f0", "f1", "f2"))), "prints")
    near = components(edges_at_anchors(reps, max_distance)).groupBy(F.col("node").alias("fid")).agg(F.min("root").alias("root"))
    members = stash(reps.join(near, "fid", "left").withColumn("root", F.coalesce("root", "fid")), "members")
    classes = members.groupBy("root").agg(F.min("least").alias("kept"), F.sum("n").alias("rows"), F.count("*").alias("kinds")).where("rows > 1")
    several = members.join(classes.where("kinds > 1").select("root"), "root", "left_semi").select("fid", "root", "f0", "f1", "f2")
    found = members.join(classes, "root").select("fid", "kept").join(count_links(several, max_distance), "fid", "left")
    out = prints.select("rid", "doc_id", "fid").distinct().join(found, "fid")
    out = stash(out.select("rid", "doc_id", F.col("kept.doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (F.col("rid") == F.col("kept.rid")).alias("keep")), "groups")
    return out, prints.select("rid")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, group_id, n_links, keep) of every document that has a near duplicate.

    group_id is the least doc_id of the class; n_links is the number of different fingerprints of the class within max_distance bits (copies, which
    share a fingerprint, are 0 apart and not counted).
    """
    return groups(docs, max_distance)[0].drop("rid")


def _has(path: str, name: str):
    """Column function: whether a written list has a hash; a worker holds the list."""

    def has(rid: pa.Array) -> pa.Array:
        own = keep("simhash", name, path, lambda: np.sort(worker_table(path).column("rid").to_numpy()))
        q = rid.to_numpy()
        return pa.array(own[np.minimum(np.searchsorted(own, q), len(own) - 1)] == q)

    return F.arrow_udf(has, "boolean")


def _listed(x: DataFrame, rids: DataFrame, name: str, there: bool) -> DataFrame:
    """Rows of x (__rid and more) whose hash is in the table (rid), or is not there.

    Up to IN_PLACE hashes every worker holds the list, so that texts stay where they are; a longer one is joined, which shuffles them.
    """
    n = rids.count()
    if not n:
        return x.limit(0) if there else x
    if n > IN_PLACE:
        return x.join(rids.withColumnRenamed("rid", "__listed"), F.col("__rid") == F.col("__listed"), "left_semi" if there else "left_anti")
    path = new_path(x.sparkSession, name)
    rids.coalesce(1).write.parquet(path)
    has = _has(path, name)(F.col("__rid"))
    return x.where(has if there else ~has)


def deduplicate(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs with one document of each group, and one row of each repeated one; columns and other rows are unchanged.

    Rows without a fingerprint (null, empty or word-less text) stay, each of them. An empty table gives an empty one.
    """
    found, rows = groups(docs, max_distance)
    x = docs.withColumn("__rid", _row_id(docs))
    out = _listed(x, found.where("not keep").select("rid"), "gone", False)
    twice = stash(rows.groupBy("rid").count().where("count > 1").select("rid"), "repeated")
    if not twice.isEmpty():  # of repeated rows one stays
        again = _listed(out, twice, "twice", True).dropDuplicates(["__rid"])
        out = _listed(out, twice, "twice", False).unionByName(again)
    return out.drop("__rid")
