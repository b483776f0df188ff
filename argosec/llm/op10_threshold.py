"""Exact top-k search by inner product with Fagin's threshold algorithm.

Queries are the rows whose id is divisible by `every`; each is held against all rows. Vectors are dealt to groups by range of
the signs of their leading principal components, so that neighbours tend to share a group; a hot direction is cut by the next
columns of the order, the last of which is the id. A task holds one group, sorts the values of each principal axis
once and goes through the queries in blocks read from the shared folder.

Sorted access goes down the lists of the axes that weigh most for the query, from the top where the query is positive and from the
bottom where it is negative; each row met is scored in full (random access). The bound is the largest score of a row that no list has shown:
one that exceeds no list's last value and whose length is at most that of the longest row of the group. A query
stops when the bound cannot beat its kth result. Two passes: in the first each query meets only its own group; the kth
score there is a floor that the second pass starts from, so that a group whose bound is below the floor is left without an access.
Where a quarter of the group's rows was met before, the rest of them are accessed in one block, and where that happens to most of the first
TRIES queries of a group, its other ones begin so: the work is then that of a matrix product.

Defined results: (query_id, vec_id, score, rank) with score rounded to 6 digits, ordered by
score and then least vec_id, without the query itself; fewer than k rows where there are fewer other vectors.
Vectors that are null, empty, zero, or hold null, NaN or infinity are no query and no result;
vectors of different length are not compared; of equal vec_ids the one with the least vector counts, so repeated rows count once; ties of
the kth score go to the least vec_id; extra columns are ignored; an empty table, or one without queries, gives an empty result.
Axes are the principal ones for the most frequent length up to AXES_DIM, else those of the vectors; they change the work, not the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosec.llm.shared import new_path, stash, worker_fs
from argosec.llm.vectors import matrix, usable

K, EVERY, GROUP_ROWS, BATCH, DIGITS = 10, 50, 16384, 256, 6
AXES_DIM, KEY_SIGNS, TRIES = 256, 8, 32
_EPS = 2 * 10.0**-DIGITS
_OUT = "query_id long, vec_id long, score double"


class Group:
    """Rows of a group with the sorted list of each axis."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, axes: np.ndarray | None):
        self.x, self.ids, self.axes = x, ids, axes
        y = x if axes is None else x @ axes
        self.order = np.argsort(y, axis=0, kind="stable").astype(np.int32)
        self.lists = np.take_along_axis(y, self.order, axis=0)
        self.longest = float(np.linalg.norm(x, axis=1).max()) * (1 + 1e-9)
        self.scored = self.tries = self.failed = 0

    def turn(self, q: np.ndarray) -> np.ndarray:
        return q if self.axes is None else q @ self.axes

    def caps(self, q: np.ndarray, depth: int) -> np.ndarray:
        """Largest value, in the direction of the query, of a row that `depth` accesses of each list have not shown."""
        last = len(self.x) - 1
        return np.where(q >= 0, self.lists[last - min(depth, last)], -self.lists[min(depth, last)])

    def bound(self, a: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest sum(a * y) with y <= caps and |y| <= longest for each row of a >= 0, and how much further y would go."""
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(a > 0, caps / a, np.inf)
        by = np.argsort(ratio, axis=1)
        ratio, t, w = (np.take_along_axis(v, by, axis=1) for v in (ratio, caps, a))
        head = lambda v: np.concatenate((np.zeros((len(v), 1)), np.cumsum(v, axis=1)), axis=1)
        used, gain, rest = head(t * t), head(w * t), head((w * w)[:, ::-1])[:, ::-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.sqrt(np.maximum(self.longest**2 - used[:, :-1], 0) / rest[:, :-1])
        fits = np.nan_to_num(scale, nan=np.inf) <= ratio
        p = np.where(fits.any(axis=1), fits.argmax(axis=1), a.shape[1])
        i = np.arange(len(a))
        s = np.where(p < a.shape[1], scale[i, np.minimum(p, a.shape[1] - 1)], 0.0)
        return gain[i, p] + np.nan_to_num(s) * rest[i, p], s


def _pick(g: Group, q_id: int, q: np.ndarray, rows: np.ndarray, score: np.ndarray, k: int, floor: float):
    """The k best of the scored rows that reach the floor, scored anew from the vectors as given."""
    kth = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
    rows = rows[(score >= max(kth, floor) - _EPS) & (score > -np.inf)]
    s = np.round((g.x[rows] * q).sum(axis=1), DIGITS) + 0.0
    by = np.lexsort((g.ids[rows], -s))[:k]
    return np.full(len(by), q_id), g.ids[rows[by]], s[by]


def _descend(g: Group, q_id: int, q: np.ndarray, turned: np.ndarray, k: int, floor: float):
    """Rows met and their scores when the bound no longer beats the kth result; None if a quarter of the rows was met before."""
    m, d = g.lists.shape
    a, up = np.abs(turned), turned >= 0
    at, seen = np.zeros(d, np.int64), np.zeros(m, bool)
    rows, score, n, kth, step = [], [], 0, floor, max(16, m // 512)
    while True:
        depth = np.minimum(at, m - 1)
        caps = np.where(up, g.lists[m - 1 - depth, np.arange(d)], -g.lists[depth, np.arange(d)])
        top, scale = g.bound(a[None], caps[None])
        if kth >= top[0] + _EPS:
            break
        if n > m // 4:
            g.scored += n
            return None
        share = a * np.minimum(caps, scale[0] * a if scale[0] else caps)
        share[at >= m] = -np.inf
        go = np.flatnonzero(share >= max(share.max() / 2, 0)) if share.max() > 0 else np.array([int(share.argmax())])
        new = np.concatenate([g.order[max(0, m - at[j] - step) : m - at[j], j] if up[j] else g.order[at[j] : at[j] + step, j] for j in go])
        new = np.unique(new[~seen[new]])
        at[go] = np.minimum(at[go] + step, m)
        seen[new] = True
        s = g.x[new] @ q
        s[g.ids[new] == q_id] = -np.inf
        rows.append(new)
        score.append(s)
        n += len(new)
        step += step // 2
        if n >= k:
            every = np.concatenate(score)
            kth = max(kth, float(np.partition(every, n - k)[n - k]))
    g.scored += n
    return (np.concatenate(rows), np.concatenate(score)) if rows else (np.zeros(0, np.int64), np.zeros(0))


def threshold_search(g: Group, q: np.ndarray, q_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vec ids, rounded scores) of the k best rows of the group, at the floor or above, for each row of q."""
    out = []
    for lo in range(0, len(q), BATCH):
        part, ids = q[lo : lo + BATCH], q_ids[lo : lo + BATCH]
        turned = g.turn(part)
        low = np.full(len(part), -np.inf) if floor is None else floor[lo : lo + BATCH].copy()
        a = np.abs(turned)
        live = g.bound(a, g.caps(turned, 0))[0] >= low - _EPS
        block = []
        for i in np.flatnonzero(live).tolist():
            got = None
            if g.tries < TRIES or 4 * g.failed < 3 * g.tries:
                got = _descend(g, int(ids[i]), part[i], turned[i], k, float(low[i]))
                g.tries += 1
                g.failed += got is None
            if got is None:
                block.append(i)
            elif len(got[0]):
                out.append(_pick(g, int(ids[i]), part[i], *got, k, float(low[i])))
        if block:
            score = part[block] @ g.x.T
            g.scored += score.size
            for i, s in zip(block, score):
                s[g.ids == ids[i]] = -np.inf
                out.append(_pick(g, int(ids[i]), part[i], np.arange(len(s)), s, k, float(low[i])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _moments(dim: int):
    """Sums of products of coordinates of a partition's vectors of one length."""

    def run(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            x = matrix(b.column(0), dim)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])

    return run


def principal_axes(x: DataFrame) -> dict[int, np.ndarray]:
    """Axes by falling weight of the most frequent length up to AXES_DIM; at most AXES_DIM ** 2 numbers reach the driver."""
    most = x.where(F.col("dim") <= AXES_DIM).groupBy("dim").count().orderBy(F.col("count").desc(), "dim").first()
    if most is None:
        return {}
    d = most["dim"]
    rows = x.where(F.col("dim") == d).select("v").mapInArrow(_moments(d), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    c = np.zeros((d, d))
    for r in rows:
        c[r["i"], r["j"]] = r["s"]
    if not np.isfinite(c).all():
        return {}
    return {d: np.ascontiguousarray(np.linalg.eigh(c)[1][:, ::-1])}


def _keys(axes: dict):
    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                x = matrix(part.column(1), d)
                y = x @ axes[d][:, :KEY_SIGNS] if d in axes else x[:, :KEY_SIGNS]
                key = (y > 0) @ (1 << np.arange(y.shape[1] - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(key), pa.array(y[:, 0]), part.column(0), part.column(1)], ["dim", "key", "first", "vec_id", "v"])

    return run


def _groups(batches, axes: dict, group_rows: int):
    """Groups of at most group_rows rows of one length from the batches of a partition."""
    held, n = [], 0

    def flush():
        t = pa.Table.from_batches(held).combine_chunks()
        dims = t.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            part = t.filter(pa.array(dims == d)).combine_chunks()
            for lo in range(0, part.num_rows, group_rows):
                s = part.slice(lo, group_rows)
                yield d, Group(matrix(s.column("v"), d), s.column("vec_id").to_numpy(), axes.get(d))

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= 4 * group_rows:  # the range partitioner has missed its mark
            yield from flush()
            held, n = [], 0
    if n:
        yield from flush()


def _seed(axes: dict, group_rows: int, k: int, every: int):
    """Queries of each group with the kth score that their own group has: the floor."""

    def run(batches):
        for d, g in _groups(batches, axes, group_rows):
            at = np.flatnonzero(g.ids % every == 0)
            q, _, s = threshold_search(g, g.x[at], g.ids[at], k)
            floor = np.full(len(at), -np.inf)
            if len(q):
                u, first, n = np.unique(q, return_index=True, return_counts=True)
                order = np.argsort(g.ids[at], kind="stable")
                place = order[np.searchsorted(g.ids[at][order], u)]
                lowest = np.minimum.reduceat(s[np.argsort(q, kind="stable")], np.concatenate(([0], np.cumsum(n)[:-1])))
                floor[place] = np.where(n >= k, lowest - _EPS, -np.inf)
            for lo in range(0, len(at), 1024):
                i = at[lo : lo + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(g.ids[i]), pa.array(np.full(len(i), d, np.int32)), pa.array(floor[lo : lo + 1024]), pa.array(list(g.x[i]), pa.list_(pa.float64()))], ["vec_id", "dim", "floor", "v"])

    return run


def _search(axes: dict, group_rows: int, k: int, queries: str):
    def run(batches):
        for d, g in _groups(batches, axes, group_rows):
            fs, bare = worker_fs(queries)
            blocks = pads.dataset(bare, filesystem=fs, format="parquet", ignore_prefixes=["_", "."]).to_batches(columns=["vec_id", "floor", "v"], filter=pads.field("dim") == d, batch_size=1024)
            for b in blocks:
                if b.num_rows:
                    a, i, s = threshold_search(g, matrix(b.column(2), d), b.column(0).to_numpy(), k, b.column(1).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best rows for every query."""
    spark = vectors.sparkSession
    x = stash(usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    axes = principal_axes(x)
    n = max(1, -(-x.count() // group_rows))
    dealt = x.select("vec_id", "v", "dim").mapInArrow(_keys(axes), "dim int, key long, first double, vec_id long, v array<double>").repartitionByRange(n, "dim", "key", "first", "vec_id")
    queries = new_path(spark, "queries")
    dealt.mapInArrow(_seed(axes, group_rows, k, every), "vec_id long, dim int, floor double, v array<double>").write.parquet(queries)
    found = dealt.mapInArrow(_search(axes, group_rows, k, queries), _OUT)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


ORACLE = f"""
WITH e AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_inner_product(a.v, b.v), {DIGITS}) AS score
  FROM e AS a JOIN e AS b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= {K}
"""
