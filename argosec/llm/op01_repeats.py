"""Suffix-array dedup: the common-prefix interval tree of all passages that occur again.

Words are separated by ASCII white space. A passage is a maximal repeat if it has at least
`min_words` words, occurs at two places or more and neither side extends it at all of them.

1. Winnowing: of each `min_words`-word window the least 24-word hash is chosen, so equal passages
   choose equal hashes. Hashes chosen once are dropped; what is left marks the candidate text.
2. Each hash is owned by one shard, that of the least row that holds it. A document sends
   each stretch of candidate text to the shards that own a hash of it, so every occurrence of a
   passage meets in the shard that owns the hash chosen at its beginning.
   Of more than two equal texts only the first two are sent, the second with the number it stands for.
3. A shard builds an enhanced suffix array (suffixes in order, with the longest common prefixes of
   neighbours) of the places where the words to the left differ, and scans it with a stack: every
   interval of the tree whose occurrences differ on the left is a maximal repeat.

Row: (repeat_id, parent_id, n_words, n_occurrences, doc_id, start_word, drop_words). An occurrence stands in
the longest repeat that begins at its place; the occurrences of a repeat are those of its row
group and of all repeats that name it, or one of those, as parent (n_occurrences counts them all).
A repeat whose occurrences all begin longer ones has one row with a null doc_id. Written so, the tree is linear in the number of suffixes, however many copies a passage has.
drop_words is the length of the longest repeat from there on that already occurs at a lesser
(doc_id, start_word), 0 if none does.

Words are compared by 32-bit hashes inside a shard and by 64-bit hashes in step 1.

Defined results: null or empty texts, and texts of fewer words than min_words, have no repeat; texts of any length are taken whole;
rows with a null doc_id (or one that is no integer) are left out, and stay as they are where passages are removed; repeated rows (doc_id and text) count once;
rows that share a doc_id but not the text are told apart by a hash of the text; passages repeated
within a document count as well; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosec.llm.shared import lean, stash
from argosec.llm.textvec import chunks, flat, grams, mix64, powers, sliding, tokenize

MIN_WORDS = 50
SHARD_WORDS = 500_000
_MUL = 0xC2B2AE3D27D4EB4F | 1
ROW = "repeat_id long, parent_id long, n_words int, n_occurrences int, doc_id long, start_word int, drop_words int, rid long"


def gram(min_words: int) -> int:
    """Words in a hash: 24 for 50, so that chosen hashes lie at most 27 places apart."""
    return max(1, min_words // 2 - 1)


def winnow(h: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the gram-word hashes chosen in the windows of each row; first: row borders."""
    w = min_words - gram(min_words) + 1
    g = grams(h, gram(min_words))
    if len(g) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(g) - w + 1  # windows
    ok = np.zeros(n, bool)
    size = np.diff(first)
    for a, s in zip(first[:-1][size >= min_words].tolist(), size[size >= min_words].tolist()):
        ok[a : a + s - min_words + 1] = True
    low = np.where(ok, sliding(g, w, np.minimum), np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    best = sliding(np.concatenate((pad, low, pad)), w, np.maximum)
    at = np.flatnonzero((best == g) & (best > 0))
    return at, g[at]


def _winnow(min_words: int):
    def run(batches):
        for b in batches:
            data, off = flat(b.column(1))
            rid = b.column(0).to_numpy()
            for a, z in chunks(off):
                t = tokenize(data[off[a] : off[z]], off[a : z + 1] - off[a], by_space=True)
                at, h = winnow(t.hash, t.first, min_words)
                row = np.searchsorted(t.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(rid[a:z][row]), pa.array(h.view(np.int64)), pa.array((at - t.first[row]).astype(np.int32))], ["rid", "h", "pos"])

    return run


_SEGMENT = "part int, rid long, doc_id long, start int, at_start boolean, weight int, words binary, pos binary, hashes binary, parts binary"


def _segments(min_words: int):
    """Stretches of candidate text: columns rid, doc_id, text, marks (array of pos, h, part), weight."""
    k = gram(min_words)
    w = min_words - k + 1

    def run(batches):
        for b in batches:
            data, off = flat(b.column(2))
            rid, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            marks, weight = b.column(3), b.column(4).to_numpy()
            begin = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(marks).to_numpy())))
            m = marks.flatten()
            pos, hs, parts = m.field(0).to_numpy(), m.field(1).to_numpy(), m.field(2).to_numpy()
            out, size = [], 0
            for a, z in chunks(off):
                t = tokenize(data[off[a] : off[z]], off[a : z + 1] - off[a], by_space=True)
                short = (t.hash >> np.uint64(32)).astype(np.uint32)
                for i in range(a, z):
                    s = slice(begin[i], begin[i + 1])
                    o = np.argsort(pos[s], kind="stable")
                    p, h, q = pos[s][o], hs[s][o], parts[s][o]
                    lo, hi = t.first[i - a], t.first[i - a + 1]
                    cut = np.flatnonzero(np.concatenate(([True], np.diff(p) > w, [True])))
                    for c, d in zip(cut[:-1], cut[1:]):
                        x, y = max(0, p[c] - w), min(hi - lo, p[d - 1] + k + w)
                        row = (int(rid[i]), int(doc[i]), int(x), bool(x == 0), int(weight[i]), short[lo + x : lo + y].tobytes(), (p[c:d] - x).astype(np.int32).tobytes(), h[c:d].tobytes(), q[c:d].astype(np.int32).tobytes())
                        for part in np.unique(q[c:d]).tolist():
                            out.append((part, *row))
                            size += len(row[5])
                    if size > 4 << 20:
                        yield _rows(out)
                        out, size = [], 0
            if out:
                yield _rows(out)

    return run


def _rows(out):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


class Shard:
    """Words of all stretches of a shard in a row, each closed by a sign of its own."""

    def __init__(self, words: list[np.ndarray]):
        size = np.array([len(x) + 1 for x in words], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(size)))
        flat_ = np.concatenate(words) if words else np.zeros(0, np.uint32)
        kinds, rank = np.unique(flat_, return_inverse=True)
        self.t = np.empty(self.begin[-1], np.int64)
        closing = self.begin[1:] - 1
        body = np.ones(len(self.t), bool)
        body[closing] = False
        self.t[body] = rank
        self.t[closing] = len(kinds) + np.arange(len(closing))
        up, self.down = powers(_MUL, len(self.t) + 1)
        self.acc = np.zeros(len(self.t) + 1, np.uint64)
        np.cumsum(mix64(self.t.astype(np.uint64), 3) * up[: len(self.t)], out=self.acc[1:])

    def hash(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.acc[at + n] - self.acc[at]) * self.down[at]

    def lcp(self, x: np.ndarray, y: np.ndarray, start: int) -> np.ndarray:
        """Longest common prefixes of suffixes that share `start` words and are not the same."""
        got = np.full(len(x), start, np.int64)
        room = len(self.t) - np.maximum(x, y)
        step = 1 << max(0, int(room.max(initial=1)).bit_length() - 1)
        live = np.arange(len(x))
        reach = 64
        while reach < step and len(live):  # most part early: find how far it is worth looking
            a, b = x[live] + got[live], y[live] + got[live]
            ok = got[live] + reach <= room[live]
            ok[ok] = self.hash(a[ok], reach) == self.hash(b[ok], reach)
            live = live[ok]
            got[live] += reach
            reach *= 2
        # each pair failed at most at the reach reached; finish with halving steps
        n = reach
        while n:
            ok = got + n <= room
            ok[ok] = self.hash((x + got)[ok], n) == self.hash((y + got)[ok], n)
            got[ok] += n
            n //= 2
        return got

    def sort(self, at: np.ndarray, bucket: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of each bucket (which share `start` words) in order; multi-way quicksort, all groups at once."""
        order = np.argsort(bucket, kind="stable")
        at, group = at[order], bucket[order].astype(np.int64)
        out_at, out_bucket = at.copy(), group.copy()
        place = np.arange(len(at))
        while len(at):
            cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            size = np.diff(cut)
            pivot = np.repeat(at[cut[:-1] + size // 2], size)
            same = at == pivot
            n = np.full(len(at), 0, np.int64)
            n[~same] = self.lcp(at[~same], pivot[~same], start)
            here, there = self.t[at + n], self.t[pivot + n]
            side = np.where(same, 0, np.where(here < there, -1, 1))
            depth = np.where(side < 0, n, -n)
            by = np.lexsort((here, depth, side, group))
            at, group, side, depth, here = (v[by] for v in (at, group, side, depth, here))
            out_at[place] = at  # the places of a group do not change, only the order in them
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (side[1:] != side[:-1]) | (depth[1:] != depth[:-1]) | (here[1:] != here[:-1])))
            group = np.cumsum(new)
            many = np.bincount(group)[group] > 1
            at, group, place = at[many], group[many], place[many]
        return out_at, out_bucket


def scan(lcp: list[int], left: list[int], rank: list[int], weight: list[int], least: int):
    """Stack scan. lcp[i]: common prefix of suffixes i and i + 1 (0 at the end of a bucket); left[i]: the
    word to the left, all different where there is none; rank: order of occurrences; weight: documents that a suffix stands for.

    Returns nodes (length, occurrences, parent) and for each suffix its node (-1: none) and its drop length.
    """
    n = len(left)
    lengths: list[int] = []
    counts: list[int] = []
    parents: list[int] = []
    node, drop = [-1] * n, [0] * n
    # an open interval: [length, left word or -1 if they differ, occurrences, open suffixes, suffixes without node, nodes without parent]
    stack: list[list] = []
    for i in range(n):
        item = [0, left[i], weight[i], [i], [i], []]
        depth = lcp[i]
        while True:
            if stack and stack[-1][0] > depth:
                top = stack.pop()
                _merge(top, item)
                item = top
                if item[1] == -1:
                    k = len(lengths)
                    lengths.append(item[0])
                    counts.append(item[2])
                    parents.append(-1)
                    for c in item[5]:
                        parents[c] = k
                    for s in item[4]:
                        node[s] = k
                    low = min(item[3], key=rank.__getitem__)
                    for s in item[3]:
                        if s != low:
                            drop[s] = item[0]
                    item[3], item[4], item[5] = [low], [], [k]
                continue
            if depth >= least:
                if stack and stack[-1][0] == depth:
                    _merge(stack[-1], item)
                else:
                    item = [depth, *item[1:]]
                    stack.append(item)
            break
    return lengths, counts, parents, node, drop


def _merge(a: list, b: list) -> None:
    if a[1] != b[1]:
        a[1] = -1
    a[2] += b[2]
    for j in (3, 4, 5):
        if len(a[j]) < len(b[j]):
            a[j], b[j] = b[j], a[j]
        a[j].extend(b[j])


def shard_repeats(part: int, t: pa.Table, min_words: int) -> pa.Table:
    w = min_words - gram(min_words) + 1
    rid, doc, start = (t.column(c).to_numpy() for c in ("rid", "doc_id", "start"))
    order = np.lexsort((start, rid))
    keep = order[np.concatenate(([True], (rid[order][1:] != rid[order][:-1]) | (start[order][1:] != start[order][:-1])))] if len(order) else order
    t = t.take(pa.array(keep))
    rid, doc, start, at_start, weight = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "doc_id", "start", "at_start", "weight"))
    words = [np.frombuffer(x, np.uint32) for x in t.column("words").to_pylist()]
    sh = Shard(words)
    # windows of min_words words, by hash; a stretch's first word has no known neighbour unless the text begins there
    n = np.array([len(x) for x in words], np.int64)
    if not len(n) or not (n >= min_words).any():
        return _result([])
    runs = np.maximum(0, n - min_words + 1)
    at = np.arange(runs.sum()) + np.repeat(sh.begin[:-1] - (np.cumsum(runs) - runs), runs)
    seg = np.repeat(np.arange(len(n)), runs)
    head = at == sh.begin[seg]
    use = ~head | at_start[seg]
    at, seg, head = at[use], seg[use], head[use]
    h = sh.hash(at, min_words)
    left = np.where(head, len(sh.t) + len(n) + seg, sh.t[np.maximum(at - 1, 0)])
    by = np.argsort(h, kind="stable")
    at, seg, left, h = at[by], seg[by], left[by], h[by]
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.append(cut, len(h)))
    diverse = (np.minimum.reduceat(left, cut) != np.maximum.reduceat(left, cut)) & (size > 1)
    # the shard that owns the least chosen hash of the window owns the passage
    first = at[cut]
    fseg = seg[cut]
    pos = [np.frombuffer(x, np.int32) for x in t.column("pos").to_pylist()]
    where = np.concatenate([p + sh.begin[i] for i, p in enumerate(pos)])
    mark = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("hashes").to_pylist()]).view(np.uint64)
    owner = np.concatenate([np.frombuffer(x, np.int32) for x in t.column("parts").to_pylist()])
    lo, hi = np.searchsorted(where, first), np.searchsorted(where, np.minimum(first + w, sh.begin[fseg + 1]))
    some = diverse & (hi > lo)
    own = np.zeros(len(cut), bool)
    idx = np.flatnonzero(some)
    if len(idx):
        low = np.full(len(idx), 2**64 - 1, np.uint64)
        whose = np.full(len(idx), -1, np.int64)
        for j in range(int((hi - lo)[idx].max())):
            k = lo[idx] + j
            ok = k < hi[idx]
            k = np.minimum(k, len(mark) - 1)
            better = ok & (mark[k] < low)
            low = np.where(better, mark[k], low)
            whose = np.where(better, owner[k], whose)
        own[idx] = whose == part
    pick = np.repeat(own, size)
    if not pick.any():
        return _result([])
    bucket = np.repeat(np.arange(len(cut)), size)[pick]
    at, bucket = sh.sort(at[pick], bucket, min_words)
    seg = np.searchsorted(sh.begin, at, "right") - 1
    head = (at == sh.begin[seg])
    left = np.where(head, len(sh.t) + len(n) + np.arange(len(at)), sh.t[np.maximum(at - 1, 0)])
    lcp = np.zeros(len(at), np.int64)
    near = np.flatnonzero(bucket[1:] == bucket[:-1])
    lcp[near] = sh.lcp(at[near], at[near + 1], min_words)
    place = at - sh.begin[seg] + start[seg]
    rank = np.empty(len(at), np.int64)
    rank[np.lexsort((rid[seg], place, doc[seg]))] = np.arange(len(at))
    lengths, counts, parents, node, drop = scan(lcp.tolist(), left.tolist(), rank.tolist(), weight[seg].tolist(), min_words)
    node, drop = np.array(node, np.int64), np.array(drop, np.int32)
    has = node >= 0
    ids = mix64(np.arange(len(lengths), dtype=np.uint64) + np.uint64(part << 32), 5).view(np.int64)
    parents = np.array(parents, np.int64)
    up = pa.array(np.where(parents >= 0, ids[np.maximum(parents, 0)], 0), mask=parents < 0) if len(parents) else pa.array([], pa.int64())
    bare = np.setdiff1d(np.arange(len(lengths)), node[has])  # every occurrence begins a longer repeat
    k = np.concatenate((node[has], bare))
    place, drop = np.append(place[has], np.zeros(len(bare), np.int64)), np.append(drop[has], np.zeros(len(bare), np.int32))
    none = np.arange(len(k)) >= has.sum()
    doc, rid = (np.append(x[seg][has], np.zeros(len(bare), np.int64)) for x in (doc, rid))
    return _result([ids[k], up.take(pa.array(k)), np.array(lengths, np.int32)[k], np.array(counts, np.int32)[k], pa.array(doc, mask=none), pa.array(place.astype(np.int32), mask=none), drop, pa.array(rid, mask=none)])


def _result(cols) -> pa.Table:
    names = [c.split()[0] for c in ROW.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols or [[]] * 8, kinds)], names)


def _shard(min_words: int):
    def run(key, t):
        return shard_repeats(key[0].as_py(), t, min_words)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    x = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return x.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows as in ROW, with rid, the hash of doc_id and text."""
    spark = docs.sparkSession
    x = _keyed(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = x.select("rid", "text").mapInArrow(lean("repeats", _winnow(min_words)), "rid long, h long, pos int").repartition(n, "h")
    # the same columns as the join below reads, so that both share one exchange
    again = chosen.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos"))["rid"].alias("label")).where("n > 1").select("h", "label")
    marks = stash(chosen.join(again, "h"), "marks")
    shards = max(1, -(-marks.count() * (min_words - gram(min_words)) // (2 * shard_words)))
    part = F.pmod(F.xxhash64("label"), F.lit(shards)).cast("int")
    by = marks.groupBy("rid").agg(F.collect_set(F.struct("pos", "h", part.alias("part"))).alias("marks"))
    # of equal texts the first two stand for all: more of them change no passage, only its count
    texts = x.select("rid", "doc_id", F.md5("text").alias("t")).join(by.select("rid"), "rid").distinct()
    order = F.struct("doc_id", "rid")
    first = texts.groupBy("t").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 2")
    later = stash(texts.join(first, "t").where(order != F.col("first")).select("t", "doc_id", "rid", "n"), "copies")
    second = later.groupBy("t").agg(F.min(order)["rid"].alias("second"), (F.first("n") - 1).cast("int").alias("weight"))
    rest = stash(later.join(second, "t").where("rid <> second").select("second", F.col("doc_id").alias("copy_id"), F.col("rid").alias("copy_rid")), "copies")
    by = by.join(rest, F.col("rid") == F.col("copy_rid"), "left_anti")
    by = by.join(second.select(F.col("second").alias("rid"), "weight"), "rid", "left")
    full = x.join(by, "rid").select("rid", "doc_id", "text", "marks", F.coalesce("weight", F.lit(1)).alias("weight"))
    segments = full.mapInArrow(lean("repeats", _segments(min_words)), _SEGMENT)
    found = stash(segments.groupBy("part").applyInArrow(_shard(min_words), ROW), "repeats")
    names = [c.split()[0] for c in ROW.split(", ")]
    more = found.join(rest, F.col("rid") == F.col("second")).withColumn("doc_id", F.col("copy_id")).withColumn("rid", F.col("copy_rid"))
    return found.unionByName(more.select(*names))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    return occurrences(docs, min_words).drop("rid")


def _cut(names: list[str]):
    """Remove word ranges: columns names..., text, n_chars given last, ranges (array of start, n)."""

    def run(batches):
        for b in batches:
            text, ranges = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            data, off = flat(text)
            out = text.to_pylist()
            begin = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(ranges), 0).to_numpy(zero_copy_only=False))))
            r = ranges.flatten()
            s, n = r.field(0).to_numpy(), r.field(1).to_numpy()
            for i in np.flatnonzero(np.diff(begin)).tolist():
                d = data[off[i] : off[i + 1]]
                t = tokenize(d, np.array([0, len(d)]), by_space=True)
                edge = np.append(t.starts, len(d))
                alive = np.ones(len(d) + 1, bool)
                for a, k in zip(s[begin[i] : begin[i + 1]].tolist(), n[begin[i] : begin[i + 1]].tolist()):
                    alive[edge[a] : edge[min(a + k, len(t.starts))]] = False
                out[i] = d[alive[:-1]].tobytes().decode("utf-8")
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.string())], [*names, "__new"])

    return run


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with every repeated passage cut out of all places but its first; documents of which nothing is left go.

    The columns and the rows without repeats stay as they are; n_chars, if it is there, is counted anew where text was cut.
    """
    drop = occurrences(docs, min_words).where("drop_words > 0").groupBy(F.col("rid").alias("__rid")).agg(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("drop_words").alias("n"))).alias("__cut"))
    names = [c for c in docs.columns if c != "text"]
    rid = F.when(F.col("doc_id").try_cast("long").isNotNull(), F.xxhash64(F.col("doc_id").try_cast("long"), F.col("text").cast("string")))
    x = docs.withColumn("__rid", rid).join(drop, "__rid", "left").select(*(F.col(f"`{c}`") for c in names), F.col("text").cast("string").alias("__text"), F.col("__cut"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    x = x.withColumn("__was", F.col("__cut").isNotNull())
    out = x.select(*(F.col(f"`{c}`") for c in names), "__was", "__text", "__cut").mapInArrow(lean("repeats", _cut([*names, "__was"])), ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "__was boolean", "__new string"]))
    out = out.where("not __was or trim(__new) <> ''")
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("__new").alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("__was"), F.length("__new").cast(kinds[c])).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)
