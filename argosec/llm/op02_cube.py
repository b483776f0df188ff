"""Mixing sources to target weights by balanced sampling with the cube method.

Each source s gets an inclusion probability pi_s = budget * w_s / tokens_s, where the w_s are
the target weights of tokens and the budget is the largest for which no probability exceeds 1
(times `fraction`). The flight phase moves the probabilities of three undecided documents at a
time along the null space of the two balancing constraints of their source, documents
(pi) and tokens (tokens), until a document is decided: the totals of decided and undecided
documents never move. Flights run in shards of a source first, of about FLIGHT_ROWS documents each, whose number follows from the
count of the largest source, then over what is left (at most two documents of each shard), in fewer shards at each
level, until one flight a source is left: no task ever holds more than about FLIGHT_ROWS documents of a source. Two documents a source are left at the end;
they land by a random draw that keeps the expected number, so each source misses its totals by less than
two units.

Weights: `weights` (source -> weight), or tokens_s ** `temperature` where it is None.

Defined results: a null source is a source of its own, a null or empty text has 0 tokens and
is balanced on documents alone; texts of any length count whole; sources of weight 0 or without tokens are dropped; equal rows
(doc_id, text, source, of any type) are drawn together, as one unit of several documents; extra columns stay; an empty table gives an empty one. The draw depends on `seed`, not on
the layout of the input: rows are ordered by a null-safe hash of doc_id, text, source and seed, so ties cannot occur.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosec.llm.shared import lean, stash
from argosec.llm.textvec import chunks, count_words, flat

TEMPERATURE, FRACTION, SEED, FLIGHT_ROWS = 0.7, 1.0, 17, 4096
_EPS = 1e-9


def flight(pi: np.ndarray, docs: np.ndarray, tokens: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase of one source. A unit stands for `docs` equal rows of `tokens` tokens in all.

    All units of a source begin with one probability, so its balancing constraints are
    sum(u * docs) = 0 and sum(u * tokens) = 0; u is their null space over three open units.
    """
    p = pi.astype(float).tolist()
    m, t = docs.astype(float).tolist(), tokens.astype(float).tolist()
    r = draw.tolist()
    held: list[int] = []
    for k in range(len(p)):
        if not _EPS < p[k] < 1 - _EPS:
            p[k] = float(round(p[k]))
            continue
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (m[b] * t[c] - m[c] * t[b], m[c] * t[a] - m[a] * t[c], m[a] * t[b] - m[b] * t[a])
        top = max(map(abs, u))
        u = tuple(x / top for x in u) if top else (1.0, -m[a] / m[b], 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(held, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(held, u) if v)
        step = up if r[k] * (up + down) < down else -down
        for i, v in zip(held, u):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
        held = [i for i in held if _EPS < p[i] < 1 - _EPS]
    out = np.array(p)
    out[out <= _EPS] = 0.0
    out[out >= 1 - _EPS] = 1.0
    return out


def land(pi: np.ndarray, draw: float) -> np.ndarray:
    """Systematic draw: each unit is taken with its probability, their number is the expected one, rounded up or down."""
    return np.diff(np.floor(np.concatenate(([0.0], np.cumsum(pi))) + 1 - draw + _EPS))


def _fly(final: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        p = flight(*(pdf[c].to_numpy() for c in ("pi", "docs", "tokens", "draw")))
        if final:
            left = (p > 0) & (p < 1)
            if left.any():
                p[left] = land(p[left], float(pdf["draw"].to_numpy()[left][0] * (1 << 26) % 1))  # the lower digits, which no flight has used
        return pdf.assign(pi=p)

    return run


def _count(batches):
    for b in batches:
        data, off = flat(b.column(2))
        n = np.zeros(b.num_rows, np.int64)
        for a, z in chunks(off):
            n[a:z] = count_words(data[off[a] : off[z]], off[a : z + 1] - off[a])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], ["source", "row", "tokens"])


def _row(seed: int):
    """Identity of a row that no layout of the input changes; equal rows share it, and null differs from every value."""
    return F.xxhash64(F.to_json(F.struct(F.col("doc_id").cast("string").alias("d"), F.col("source").cast("string").alias("s"), F.col("text").isNull().alias("n"))), F.col("text").cast("string"), F.lit(seed))


def inclusion(units: DataFrame, weights: dict | None, temperature: float, fraction: float) -> DataFrame:
    """(s, pi): the probability of each source that has a positive weight and tokens."""
    totals = units.groupBy("source").agg(F.sum("tokens").alias("total"))
    if weights is None:
        totals = totals.withColumn("w", F.pow(F.col("total").cast("double"), F.lit(temperature)))
    else:
        given = units.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        totals = totals.join(given, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    totals = totals.where("total > 0 and w > 0")
    budget = totals.agg(F.min(F.col("total") / F.col("w")).alias("b"))
    return totals.crossJoin(F.broadcast(budget)).select(F.col("source").alias("s"), F.least(F.lit(1.0), F.col("b") * fraction * F.col("w") / F.col("total")).alias("pi"))


def _redraw(units: DataFrame, seed: int, level: int) -> DataFrame:
    """units with a random number of their own at each level."""
    return units.withColumn("draw", F.shiftrightunsigned(F.xxhash64("row", F.lit(seed), F.lit(level)), 11).cast("double") / float(1 << 53))


def draw(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE, fraction: float = FRACTION, seed: int = SEED, flight_rows: int = FLIGHT_ROWS) -> DataFrame:
    """(row): hashes of the drawn rows of docs."""
    use = docs.select(F.col("source").cast("string").alias("source"), _row(seed).alias("row"), F.col("text").cast("string").alias("text"))
    counted = use.mapInArrow(lean("cube", _count), "source string, row long, tokens long")
    units = stash(counted.groupBy("source", "row").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), "units")
    pi = inclusion(units, weights, temperature, fraction)
    drawn = units.join(F.broadcast(pi), F.col("source").eqNullSafe(F.col("s"))).drop("s")  # a row a source: see README for sources without number
    drawn = _redraw(drawn.withColumn("deal", F.xxhash64("row", F.lit(seed))), seed, 0).select("source", "row", "docs", "tokens", "pi", "draw", "deal")
    schema = "source string, row long, docs long, tokens long, pi double, draw double, deal long"
    taken = [drawn.where(F.col("pi") >= 1 - _EPS).select("row")]
    left = drawn.where(F.col("pi") < 1 - _EPS)
    most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    level = 0
    while most > flight_rows:
        level += 1
        shards = -(-most // flight_rows)  # at most two documents of each flight are left
        flown = stash(left.groupBy("source", F.pmod("deal", F.lit(shards)).alias("shard")).applyInPandas(_fly(False), schema), "flown")
        taken.append(flown.where("pi = 1").select("row"))
        left, most = _redraw(flown.where("pi > 0 and pi < 1").drop("draw"), seed, level).select(*(c.split()[0] for c in schema.split(", "))), 2 * shards
    final = stash(left.groupBy("source").applyInPandas(_fly(True), schema), "flown")
    out = final.where("pi = 1").select("row")
    for t in taken:
        out = out.union(t)
    return out


def mix(docs: DataFrame, columns: list[str] | None = None, **kw) -> DataFrame:
    """The drawn rows of docs, with all their columns as they were, or only those named."""
    kept = draw(docs, **kw).select(F.col("row").alias("__row")).distinct()
    names = columns or docs.columns
    own = docs.select(*(F.col(f"`{c}`") for c in names), _row(kw.get("seed", SEED)).alias("__own"))  # the hash is a column, so texts that are not asked for stay out of the join
    return own.join(kept, own["__own"] == kept["__row"], "left_semi").drop("__own")
