"""Embedding near-dedup by sorted projection passes.

In each pass a vector's key is the concatenation of 63 random hyperplane signs of the unit vector less the mean of
all unit vectors of its length. Vectors are
ordered by (pass, key) with a range partitioning, each is compared with the `window` next ones,
and pairs of cosine `threshold` or more, computed exactly, are united across passes. Rows
at the partition borders are compared in a second, small step. The number of passes
follows from the vectors: one pass measures for each how many leading signs it shares with the rows `window`
before and behind it. A pair at the threshold, whose angle as seen from the mean is the wider the nearer it lies to the mean,
shares one sign more with probability (1 - angle / pi) ** signs, and as many passes are made as leave
pairs apart in all of them with a mean probability of `miss` at most: not fewer than evenly spread vectors need, nor more
than make as many comparisons as there are pairs. Vectors that match the row `window` away don't count, as their crowd is united anyway. Equal vectors are folded before the
passes, so that they fill no window.

Defined results: (vec_id, group_id, keep) of each vector that has a near duplicate, where
group_id is the least vec_id. Vectors that are null, empty, zero, or hold null, NaN or
infinity belong to no group; vectors of different length never match; a repeated vec_id counts
once for each distinct vector; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosec.llm.shared import components, stash
from argosec.llm.vectors import matrix, usable

THRESHOLD, WINDOW, MISS, BITS = 0.95, 24, 0.01, 63
_OUT = "kind string, pid int, pass int, dim int, key long, id long, v array<double>, b long"
_NAMES = ["kind", "pid", "pass", "dim", "key", "id", "v", "b"]


def passes(n: int, threshold: float, window: int, miss: float) -> int:
    shared = (1 - math.acos(threshold) / math.pi) ** max(0.0, math.log2(max(n, 2) / window))
    return max(1, math.ceil(math.log(miss) / math.log(1 - shared))) if shared < 1 else 1


def _mean(batches):
    """Sum and number of unit vectors for each length in a partition."""
    held = {}
    for b in batches:
        dims = b.column(2).to_numpy()
        for d in np.unique(dims).tolist():
            x = matrix(b.filter(pa.array(dims == d)).column(1), d)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            n, total = held.get(d, (0, 0.0))
            held[d] = n + len(x), total + x.sum(axis=0)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([t for _, t in held.values()], pa.list_(pa.float64()))], ["dim", "n", "total"])


def _occupancy(window: int, threshold: float, mean: dict):
    """Rows by number of shared signs and angle (in hundredths, as seen from the mean) of a pair at the threshold."""
    chord = math.sqrt(2 - 2 * threshold) / 2

    def run(batches):
        for b in batches:
            dims, key = b.column(1).to_numpy(), b.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x, k = matrix(b.column(4).take(pa.array(at)), d), key[at]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                shared, crowd = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
                if len(x) > window:
                    same = BITS - np.ceil(np.log2((k[window:] ^ k[:-window]) + 1.0)).astype(np.int64)
                    shared[window:] = same
                    shared[:-window] = np.maximum(shared[:-window], same)
                    shared += 1
                    near = np.einsum("ij,ij->i", x[window:], x[:-window]) >= threshold
                    crowd[window:] = near
                    crowd[:-window] |= near
                r = np.linalg.norm(x - mean[d], axis=1)
                angle = np.ceil(200 * np.arcsin(np.minimum(1, chord / np.maximum(r, chord)))).astype(np.int64)
                u, n = np.unique((np.minimum(angle, 157) * 64 + np.clip(shared, 0, 63))[~crowd & (r > chord)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["at", "n"])

    return run


def measured_passes(at: np.ndarray, n: np.ndarray, miss: float, most: int) -> int:
    """Passes after which a pair is missed with a mean probability of `miss`, for the rows of _occupancy."""
    p = (1 - at // 64 / 100 / math.pi) ** (at % 64)
    low, high = 1, max(1, most)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if (n * (1 - p) ** mid).sum() <= miss * n.sum() else (mid + 1, high)
    return low


def _keys(n_passes: int, mean: dict):
    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = matrix(part.column(1), int(d))
                x = x / np.linalg.norm(x, axis=1, keepdims=True) - mean[int(d)]
                for p in range(n_passes):
                    plane = np.random.default_rng([91, p, int(d)]).standard_normal((int(d), BITS))
                    key = ((x @ plane) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), part.column(2), pa.array(key), part.column(0), part.column(1)], ["pass", "dim", "key", "id", "v"])

    return run


def _pairs(t: pa.Table | pa.RecordBatch, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of matching pairs at most `window` rows apart in a sorted table of one or more (dim, pass)."""
    dims, ps, ids = (t.column(c).to_numpy() for c in ("dim", "pass", "id"))
    out = []
    cut = np.flatnonzero(np.concatenate(([True], dims[1:] != dims[:-1], [True])))
    for a, z in zip(cut[:-1], cut[1:]):
        x = matrix(t.column("v").slice(a, z - a), int(dims[a]))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for off in range(1, min(window, z - a - 1) + 1):
            near = (np.einsum("ij,ij->i", x[off:], x[:-off]) >= threshold) & (ps[a + off : z] == ps[a : z - off]) & (ids[a + off : z] != ids[a : z - off])
            i = np.flatnonzero(near) + a
            out.append((ids[i], ids[i + off]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _edge_batch(a, b):
    n = len(a)
    null = lambda kind: pa.nulls(n, kind)
    return pa.RecordBatch.from_arrays([pa.array(["pair"] * n, pa.string()), null(pa.int32()), null(pa.int32()), null(pa.int32()), null(pa.int64()), pa.array(a), null(pa.list_(pa.float64())), pa.array(b)], _NAMES)


def _border_batch(kind, t):
    n, pid = t.num_rows, TaskContext.get().partitionId()
    t = t.combine_chunks() if isinstance(t, pa.Table) else t
    cols = [t.column(c) for c in ("pass", "dim", "key", "id", "v")]
    cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
    cols[4] = cols[4].cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(np.full(n, pid, np.int32)), *cols, pa.nulls(n, pa.int64())], _NAMES)


def _scan(window: int, threshold: float):
    def run(batches):
        tail = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if tail is None:
                yield _border_batch("head", t.slice(0, window))
            else:
                t = pa.concat_tables([tail, t])
            for at in range(0, t.num_rows, 4096):
                yield _edge_batch(*_pairs(t.slice(at, 4096 + window), window, threshold))
            tail = t.slice(max(0, t.num_rows - window))
        if tail is not None:
            yield _border_batch("tail", tail)

    return run


def _borders(window: int, threshold: float):
    def run(t: pa.Table) -> pa.Table:
        a, b = _pairs(t.sort_by([("dim", "ascending"), ("pass", "ascending"), ("key", "ascending"), ("id", "ascending")]).combine_chunks(), 2 * window, threshold)
        return pa.table({"a": a, "b": b})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """(vec_id, group_id, keep) of every vector with a near duplicate."""
    spark = vectors.sparkSession
    x = stash(usable(vectors), "vectors")
    reps = x.groupBy("v", "dim").agg(F.min("vec_id").alias("vec_id"))
    reps = stash(reps.select("vec_id", "v", "dim"), "vectors")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, order = "pass int, dim int, key long, id long, v array<double>", ["dim", "pass", "key", "id"]
    sums, size = {}, {}
    for r in reps.mapInArrow(_mean, "dim int, n long, total array<double>").collect():  # a row a partition and length
        sums[r.dim] = sums.get(r.dim, 0.0) + np.array(r.total)
        size[r.dim] = size.get(r.dim, 0) + r.n
    mean, count = {d: sums[d] / size[d] for d in sums}, sum(size.values())
    first = reps.mapInArrow(_keys(1, mean), keys).repartitionByRange(n, *order).sortWithinPartitions(*order)
    seen = first.mapInArrow(_occupancy(window, threshold, mean), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # some thousand rows at most
    need = passes(count, threshold, window, miss)
    if seen:
        need = max(need, measured_passes(np.array([r.at for r in seen]), np.array([r.n for r in seen]), miss, math.ceil(count / (2 * window))))
    keyed = reps.mapInArrow(_keys(need, mean), keys)
    found = stash(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_scan(window, threshold), _OUT), "passes")
    border = found.where("kind <> 'pair'")
    nxt = border.select("pid").distinct().withColumn("next", F.lead("pid").over(Window.orderBy("pid")))  # a row a partition
    ends = border.where("kind = 'tail'").join(nxt, "pid").where("next is not null").withColumn("pid", F.col("next")).drop("next")
    met = ends.unionByName(border.where("kind = 'head'")).groupBy("pid").applyInArrow(_borders(window, threshold), "a long, b long")
    same = x.join(reps.withColumnRenamed("vec_id", "b"), ["v", "dim"]).select(F.col("vec_id").alias("a"), "b").where("a <> b")
    near = components(found.where("kind = 'pair'").select(F.col("id").alias("a"), "b").union(met).union(same))
    return near.groupBy(F.col("node").alias("vec_id")).agg(F.min("root").alias("group_id")).withColumn("keep", F.col("vec_id") == F.col("group_id"))
