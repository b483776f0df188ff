"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward input."""

import base64
import collections
import hashlib
import itertools
import math
import os
import random
import re
import tracemalloc
import weakref
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from argosec.llm import op01_repeats as op1
from argosec.llm import op02_cube as op2
from argosec.llm import op03_simhash as op3
from argosec.llm import op04_pseudo as op4
from argosec.llm import op05_projection as op5
from argosec.llm import op06_bpe as op6
from argosec.llm import op07_kneser_ney as op7
from argosec.llm import op08_warc as op8
from argosec.llm import op09_chat as op9
from argosec.llm import op10_threshold as op10
from argosec.llm import shared, textvec
from argosec.llm.shared import components, shared_dir
from argosec.llm.textvec import HashIndex, count_words, flat, grams, mix64, sliding, tokenize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "in", "or", "ust")]


def words(rng, n):
    return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows], DOCS)


# awkward rows: nulls everywhere, empty and long texts, repeated rows
AWKWARD = [(1, None, None, None), (None, "some text here", "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, "a"), (4, "one", "en", None), (5, "x " * 40_000, "en", "b"), (5, "x " * 40_000, "en", "b"), (6, "été 日本語 🎉 … $$$", "fr", "b"), (7, "a" * 200_000, "en", "b"), (8, "one", "en", "a"), (8, "two words", "de", "a")]


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, AWKWARD).withColumn("text_", F.lit(1)).withColumn("rid", F.lit("clash")).withColumn("tokens", F.lit("clash")).withColumn("label", F.lit(2.5)).withColumn("row", F.lit(1)).withColumn("h", F.lit("c"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 0, None), (None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")


# kernels
def test_tokens_and_hashes():
    texts = ["ab, cd  ab", "", "$$x $$", "ab"]
    data, off = flat(pa.array(texts))
    t = tokenize(data, off, False)
    got = [data[a:b].tobytes().decode() for a, b in zip(t.starts, t.ends)]
    assert got == ["ab", ",", "cd", "ab", "$$", "x", "$$", "ab"] and list(t.first) == [0, 4, 4, 7, 8]
    by = collections.defaultdict(set)
    for w, h in zip(got, t.hash.tolist()):
        by[w].add(h)
    assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)
    assert list(count_words(data, off)) == [len(x.split()) for x in texts]
    assert count_words(*flat(pa.array(["a b", "c", "", " d"]))).tolist() == [2, 1, 0, 1]


def test_grams_and_windows():
    a = mix64(np.arange(50, dtype=np.uint64) % np.uint64(5))
    g = grams(a, 3)
    assert len(set(g.tolist())) == 5 and g[0] == g[5]
    for w in (1, 2, 3, 7, 27):
        assert sliding(a, w, np.minimum).tolist() == [a[i : i + w].min() for i in range(len(a) - w + 1)]


def test_hash_index():
    k = mix64(np.arange(5000, dtype=np.uint64))
    ix = HashIndex(k, np.arange(5000, dtype=np.float32))
    assert (ix.find(k) == np.arange(5000)).all() and (ix.find(mix64(np.arange(9000, 9900, dtype=np.uint64))) == -1).all()
    assert (HashIndex(k[:0], np.zeros(0, np.float32)).get(k[:3], 7) == 7).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 repeats
def maximal_repeats(docs, least):
    places = collections.defaultdict(list)
    for d, t in docs.items():
        for i in range(len(t)):
            for n in range(least, len(t) - i + 1):
                places[tuple(t[i : i + n])].append((d, i))
    out = {}
    for k, v in places.items():
        left = {docs[d][i - 1] if i else ("^", d) for d, i in v}
        right = {docs[d][i + len(k)] if i + len(k) < len(docs[d]) else ("$", d) for d, i in v}
        if len(v) > 1 and len(left) > 1 and len(right) > 1:
            out[k] = sorted(v)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_all_maximal_repeats(spark, seed):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") for _ in range(50)]
    docs = {}
    for d in range(12):
        t = [rng.choice("abcdefghijkl") for _ in range(rng.choice([0, 3, 25]))]
        for _ in range(rng.choice([0, 1, 2])):
            a = rng.randrange(40)
            t += base[a : a + rng.randrange(4, 25)] + [rng.choice("xyz")]
        docs[d] = t + t[:15] if rng.random() < 0.3 else t
    docs |= {20 + i: docs[3] for i in range(3)} | {30 + i: docs[5] + base[:9] for i in range(5)} | {40 + i: base[:20] for i in range(4)}
    rows = op1.occurrences(frame(spark, [(d, " ".join(t), "en", "s") for d, t in docs.items()]), 6, 150).collect()
    parent = {r.repeat_id: r.parent_id for r in rows}
    length = {r.repeat_id: (r.n_words, r.n_occurrences) for r in rows}
    got = collections.defaultdict(set)
    for r in rows:
        k = r.repeat_id if r.doc_id is not None else None
        while k is not None:
            got[k].add((r.doc_id, r.start_word))
            k = parent[k]
    found = {}
    for k, v in got.items():
        d, i = min(v)
        found[tuple(docs[d][i : i + length[k][0]])] = sorted(v)
        assert length[k][1] == len(v)
    want = maximal_repeats(docs, 6)
    assert found == want
    drop = {}
    for k, v in want.items():
        for o in v[1:]:
            drop[o] = max(drop.get(o, 0), len(k))
    assert {(r.doc_id, r.start_word): r.drop_words for r in rows if r.drop_words} == drop


def test_remove_repeats_leaves_one_copy(spark):
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    rows = [(i, " ".join(words(rng, 30)) + "\n" + passage + "  " + " ".join(words(rng, 20)), "en", "s") for i in range(6)]
    rows += [(10, passage, "en", "s"), (11, " ".join(words(rng, 80)), "en", "s"), (12, None, None, None)]
    got = {r.doc_id: r for r in op1.remove_repeats(frame(spark, rows)).collect()}
    assert passage in got[0].text and got[0].text == rows[0][1] and got[11].text == rows[7][1] and got[12].text is None
    assert all(passage not in got[i].text and got[i].n_chars == len(got[i].text) for i in range(1, 6)) and 10 not in got
    again = op1.repeats(frame(spark, [(r.doc_id, r.text, "en", "s") for r in got.values()]))
    assert again.count() == 0


def test_repeats_awkward(spark, awkward):
    r = op1.repeats(awkward).collect()
    assert {x.doc_id for x in r if x.doc_id is not None} <= {5}
    out = op1.remove_repeats(awkward)
    assert out.columns == awkward.columns and {1, 2, 3, 4, 6, 7, 8} <= {x.doc_id for x in out.collect()}
    assert op1.repeats(awkward.limit(0)).count() == 0 and op1.remove_repeats(awkward.limit(0)).count() == 0


# 2 cube
def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    pi, docs, tokens = np.full(400, 0.37), rng.integers(1, 3, 400), rng.integers(0, 900, 400)
    p = op2.flight(pi, docs, tokens, rng.random(400))
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert abs((p * docs).sum() - (pi * docs).sum()) < 1e-6 and abs((p * tokens).sum() - (pi * tokens).sum()) < 1e-4


def test_draw_is_unbiased():
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 50, 12)
    hits = np.zeros(12)
    for _ in range(3000):
        p = op2.flight(np.full(12, 0.4), np.ones(12), tokens, rng.random(12))
        left = (p > 0) & (p < 1)
        p[left] = op2.land(p[left], rng.random())
        hits += p
    assert np.abs(hits / 3000 - 0.4).max() < 0.05


def test_mix_meets_the_weights(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60))), "en", "abc"[min(2, rng.randrange(5))]) for i in range(3000)]
    df = frame(spark, rows)
    target = {"a": 0.5, "b": 0.3, "c": 0.2}
    out = op2.mix(df, weights=target).toPandas()
    t = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    t["n"], out["n"] = t.text.str.split().str.len(), out.text.str.split().str.len()
    total, docs = t.groupby("source").n.sum(), t.groupby("source").size()
    budget = min(total[s] / w for s, w in target.items())
    got, got_docs = out.groupby("source").n.sum(), out.groupby("source").size()
    for s, w in target.items():
        assert abs(got[s] - budget * w) <= 2 * 60 and abs(got_docs[s] - docs[s] * budget * w / total[s]) < 3
    again = op2.mix(df.repartition(7), weights=target).toPandas()
    assert sorted(again.doc_id) == sorted(out.doc_id)


def brute_cube(units, seed, flight_rows, pi, random_of):
    """The documented draw by plain loops: (row, docs, tokens, deal) of one source."""
    decided, level = {}, 0
    p = {u[0]: pi for u in units}

    def fly(rows, level):
        held = []
        for u in sorted(rows):
            held.append(u)
            if len(held) == 3:
                v = np.cross([float(h[1]) for h in held], [float(h[2]) for h in held])
                v = v / np.abs(v).max() if np.abs(v).max() else np.array([1.0, -held[0][1] / held[1][1], 0.0])
                up = min([(1 - p[h[0]]) / x if x > 0 else p[h[0]] / -x for h, x in zip(held, v) if x])
                down = min([p[h[0]] / x if x > 0 else (1 - p[h[0]]) / -x for h, x in zip(held, v) if x])
                step = up if random_of(u[0], level) * (up + down) < down else -down
                for h, x in zip(held, v):
                    p[h[0]] = min(1.0, max(0.0, p[h[0]] + step * x))
                held = [h for h in held if 1e-9 < p[h[0]] < 1 - 1e-9]
        return held

    left, most = list(units), len(units)
    while most > flight_rows:
        shards = -(-most // flight_rows)
        left = [u for s in range(shards) for u in fly([u for u in left if u[3] % shards == s], level)]
        most, level = 2 * shards, level + 1
    left = fly(left, level)
    if left:
        x, total = random_of(left[0][0], level) * 2**26 % 1, 0.0
        for u in left:
            before, total = math.floor(total + 1 - x + 1e-9), total + p[u[0]]
            p[u[0]] = math.floor(total + 1 - x + 1e-9) - before
    return {u[0] for u in units if p[u[0]] > 0.5}


@pytest.mark.parametrize("flight_rows", [9, 4096])
def test_draw_against_brute_force(spark, flight_rows):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 40))), "en", "ab"[i % 3 == 0]) for i in range(400)]
    rows += rows[:30]
    df = frame(spark, rows)
    weights = {"a": 0.3, "b": 0.7}
    ident = df.select("source", op2._row(op2.SEED).alias("row"), F.size(F.split(F.trim("text"), r"\s+")).alias("n"), F.length("text").alias("c"))
    ident = ident.groupBy("source", "row").agg(F.count("*").alias("docs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tokens"), F.xxhash64("row", F.lit(op2.SEED)).alias("deal"))
    levels = [op2._redraw(ident, op2.SEED, k) for k in range(6)]
    number = {(r.row, k): r.draw for k, d in enumerate(levels) for r in d.collect()}
    units = collections.defaultdict(list)
    for r in ident.collect():
        units[r.source].append((r.row, r.docs, r.tokens, r.deal))
    total = {s: sum(u[2] for u in v) for s, v in units.items()}
    budget = min(total[s] / w for s, w in weights.items())
    want = set()
    for s, v in units.items():
        pi = min(1.0, budget * weights[s] / total[s])
        want |= {u[0] for u in v} if pi > 1 - 1e-9 else brute_cube(v, op2.SEED, flight_rows, pi, lambda r, k: number[r, k])
    got = {r.row for r in op2.draw(df, weights, flight_rows=flight_rows).collect()}
    assert got == want and len(got) > 100


def test_row_identity_is_null_safe(spark):
    df = spark.createDataFrame([(None, "7", "s"), ("7", None, "s"), ("7", "s", None), (None, None, None), ("7", "", "s")], "doc_id string, text string, source string")
    assert df.select(op2._row(1)).distinct().count() == 5
    assert df.select(op3._row_id(df).alias("r")).distinct().count() == 5


def test_mix_awkward(spark, awkward):
    out = op2.mix(awkward)
    assert out.columns == awkward.columns and out.count() <= awkward.count()
    assert op2.mix(awkward.limit(0)).count() == 0
    assert op2.mix(awkward, weights={"b": 1.0, "nowhere": 1.0}).select("source").distinct().count() == 1


# 3 simhash
def test_every_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**31, 300, dtype=np.uint64)
    near = x ^ (np.uint64(1) << rng.integers(0, 31, 300).astype(np.uint64))
    a, b = op3.anchors(x), op3.anchors(near)
    for i in range(300):
        assert set(a[1][a[0] == i].tolist()) & set(b[1][b[0] == i].tolist())
    code = {int(w) for w in a[1]}
    assert all(len(op3.anchors(np.array([c], np.uint64))[0]) == 1 for c in list(code)[:50])


def test_fingerprints_do_not_depend_on_neighbours():
    texts = ["alpha beta gamma", "", "delta " * 900 + "x", "alpha beta gamma"]
    whole, n = op3.fingerprints(*flat(pa.array(texts * 3000)))
    one = np.concatenate([op3.fingerprints(*flat(pa.array([t])))[0] for t in texts])
    assert (whole.reshape(-1, 4, 3) == one).all() and n[:4].tolist() == [3, 0, 2, 3]


def brute_groups(ids, fp, most):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(zip(ids, fp), 2):
        if op3.distance(x, y) <= most:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(30, 250))
        rows.append((10 * i, " ".join(w)))
        for c in range(rng.choice([0, 0, 1, 3])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 3, 6])):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            rows.append((10 * i + c + 1, " ".join(v).upper() if rng.random() < 0.2 else ", ".join(v)))
    fp, _ = op3.fingerprints(*flat(pa.array([t.lower() for _, t in rows])))
    want = brute_groups([i for i, _ in rows], fp, op3.MAX_DISTANCE)
    found = op3.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    got = {r.doc_id: r.group_id for r in found}
    kinds = {tuple(f) for f in fp.tolist()}
    near = {f: sum(int(op3.distance(np.array(f, np.uint64), np.array(g, np.uint64))) <= op3.MAX_DISTANCE for g in kinds) - 1 for f in kinds}
    links = {i: near[tuple(f)] for (i, _), f in zip(rows, fp.tolist())}
    assert np.mean([r.n_links == links[r.doc_id] for r in found]) >= 0.95 and all(r.n_links <= links[r.doc_id] for r in found)
    pairs = [(a, b) for a, b in itertools.combinations(want, 2) if want[a] == want[b]]
    caught = sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs)
    assert len(pairs) > 40 and caught >= 0.9 * len(pairs)
    assert all(want[a] == want[g] for a, g in got.items())
    exact = brute_groups([i for i, _ in rows], fp, 2 * op3.BLOCKS - 1)
    assert all(got.get(a) == got.get(b) for a, b in itertools.combinations(exact, 2) if exact[a] == exact[b])


def test_large_bucket_is_exact():
    rng = np.random.default_rng(3)
    fp = np.repeat(rng.integers(0, 2**62, (40, 3), dtype=np.uint64), 40, axis=0)
    fp[:, 0] ^= np.uint64(1) << rng.integers(0, 62, len(fp)).astype(np.uint64)
    a, b = op3._bucket_edges(np.arange(len(fp)), fp, 4, step=100)
    assert len(a) == len(fp) - 40 and (a // 40 == b // 40).all()


def test_simhash_awkward(spark, awkward):
    got = {(r.doc_id, r.group_id, r.keep) for r in op3.near_duplicates(awkward).collect()}
    assert {(4, 4, True), (8, 4, False)} <= got and not {1, 2, 3, None} & {g[0] for g in got}
    out = op3.deduplicate(awkward)
    kept = sorted((str(r.doc_id), str(r.text)[:9]) for r in out.collect())
    assert out.columns == awkward.columns and len(kept) == len(AWKWARD) - 2  # the second row of 5 and the copy of 'one'
    assert ("8", "two words") in kept and ("8", "one") not in kept and ("None", "some text") in kept
    assert op3.near_duplicates(awkward.limit(0)).count() == 0 and op3.deduplicate(awkward.limit(0)).count() == 0


def test_deduplicate_goes_by_row_and_not_by_id(spark):
    rows = [(4, "one common text"), (8, "one common text"), (8, "a wholly different thing here"), (None, "one common text"), (9, "said twice over again"), (9, "said twice over again"), (3, None), (3, None), (2, " "), (2, " ")]
    got = sorted((str(r.doc_id), str(r.text)) for r in op3.deduplicate(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect())
    assert got == sorted([("4", "one common text"), ("8", "a wholly different thing here"), ("9", "said twice over again"), ("3", "None"), ("3", "None"), ("2", " "), ("2", " ")])


def test_deduplicate_leaves_texts_in_place(spark, monkeypatch):
    rng = random.Random(31)
    text = [" ".join(words(rng, 30)) for _ in range(60)]
    rows = [(i, t, "en", "s") for i, t in enumerate(text + text[:25])] + [(3, text[3], "en", "s"), (50, text[50], "en", "s"), (99, None, "en", "s"), (99, None, "en", "s")]
    df = frame(spark, rows)
    want = sorted([(i, t) for i, t in enumerate(text)] + [(99, None)] * 2, key=str)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a table that has grown
    try:
        for most in (op3.IN_PLACE, 1):
            monkeypatch.setattr(op3, "IN_PLACE", most)
            out = op3.deduplicate(df)
            assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want
            plan = op3.deduplicate(df.dropDuplicates().localCheckpoint())._jdf.queryExecution().executedPlan().toString()
            assert ("Exchange" in plan) == (most == 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_anchors_are_compared_in_cells(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, (3, 3), dtype=np.uint64)
    root = rng.choice(3, 260, p=[0.9, 0.06, 0.04])
    flips = rng.integers(31, 62, (260, 3)).astype(np.uint64)  # one half of each word stays, so all of a root share anchors
    fp = base[root] ^ (np.uint64(1) << flips)
    df = spark.createDataFrame([(i, *(int(v) for v in fp[i].view(np.int64))) for i in range(260)], "fid long, f0 long, f1 long, f2 long")
    want = brute_groups(list(range(260)), fp, 6)
    for cell in (4096, 30):
        got = {r.node: r.root for r in components(op3.edges_at_anchors(df, 6, cell)).collect()}
        assert {i: got.get(i, i) for i in range(260)} == want
    assert len(set(want.values())) == 3
    batch = lambda k: pa.RecordBatch.from_arrays([pa.array(k), pa.array(range(len(k)))], ["k", "i"])
    parts = list(op3._by_key(map(batch, ([1, 1, 2], [2, 2, 2, 2], [2, 3], [3], [4, 5, 5])), 3))
    assert sum(len(c[0]) for _, c in parts) == 13 and {k for hot, c in parts if hot for k in c[0].tolist()} == {2}
    assert [sorted(set(c[0].tolist())) for hot, c in parts if not hot] == [[1], [3, 4], [5]]


def far_pairs(rng, n, most):
    """Fingerprints in pairs `most` bits apart, and as many that are one bit further."""
    fp = rng.integers(0, 2**62, (n, 3), dtype=np.uint64)
    other = fp.copy()
    for i in range(n):
        for p in rng.choice(186, most + (i >= n // 2), replace=False):
            other[i, p // 62] ^= np.uint64(1 << int(p % 62))
    return np.concatenate([fp, other])


@pytest.mark.parametrize("cell, shard", [(op3.CELL, 400_000), (3, 400_000), (op3.CELL, 2), (3, 2)])
def test_no_pair_up_to_the_threshold_is_lost(spark, cell, shard):
    n, most = 400, op3.MAX_DISTANCE
    fp = far_pairs(np.random.default_rng(8), n, most)
    df = spark.createDataFrame([(i, *(int(v) for v in f.view(np.int64))) for i, f in enumerate(fp)], "fid long, f0 long, f1 long, f2 long")
    got = {(r.a, r.b) for r in op3.edges_at_anchors(df, most, cell, shard).collect()}
    assert got == {(n + i, i) for i in range(n // 2)}


def test_parts_leave_no_room():
    for most in (12, 13, 14, 24, 40):
        cut = op3.parts(most)
        assert sum(r + 1 for _, _, r in cut) == most + 1 and all(a + b <= c for (a, b, _), (c, _, _) in zip(cut, cut[1:])) and cut[-1][0] + cut[-1][1] <= 186


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, (4, 3), dtype=np.uint64)
    root = rng.choice(4, 300, p=[0.8, 0.1, 0.07, 0.03])
    fp = base[root] ^ (np.uint64(1) << rng.integers(0, 62, (300, 3)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 62, (300, 3)).astype(np.uint64))
    want = [sum(op3.distance(fp[i], fp[j]) <= 7 for j in range(300) if j != i and root[i] == root[j]) for i in range(300)]
    df = spark.createDataFrame([(i, int(root[i]), *(int(v) for v in fp[i].view(np.int64))) for i in range(300)], "fid long, root long, f0 long, f1 long, f2 long")
    for cell in (4096, 60, 7):
        assert {r.fid: r.n_links for r in op3.count_links(df, 7, cell).collect()} == dict(enumerate(want))


# 4 language model
def test_network_gradient():
    rng = np.random.default_rng(0)
    net = op4.Net()
    ids, row = rng.integers(0, op4.VOCAB, 40).astype(np.int32), np.repeat(np.arange(4), 10)
    ctx = op4.Net.context(ids, row)
    assert (ctx[:, 0] == [op4.VOCAB, (op4.VOCAB + 1) + ids[1], 2 * (op4.VOCAB + 1) + op4.VOCAB, 3 * (op4.VOCAB + 1) + ids[2]]).all()
    loss = lambda n: -n.forward(ids, ctx)[-1].astype(float).mean()
    g2 = op4.Net(np.zeros_like(net.w))
    before, w = loss(net), net.w.copy()
    net.step(ids, ctx, g2, 0.0)
    grad = np.sqrt(g2.w)
    at = np.argsort(grad)[-5:]
    for i in at:
        up, down = w.copy(), w.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs(abs(loss(op4.Net(up)) - loss(op4.Net(down))) / 2e-2 - grad[i]) < 0.1 * grad[i] + 1e-4
    for _ in range(30):
        net.step(ids, ctx, g2, 0.1)
    assert loss(net) < before - 1
    p = np.exp(op4.Net().forward(np.arange(op4.VOCAB, dtype=np.int32), np.tile(ctx[:, :1], (1, op4.VOCAB)))[-1].astype(float))
    assert abs(p.sum() - 1) < 1e-3


def test_exponents_of_small_and_large_numbers():
    rng = np.random.default_rng(8)
    for scale in (1, 15, 200):
        z = (rng.standard_normal((500, 15)) * scale).astype(np.float32)
        want = np.exp(z.astype(float) - z.max(axis=1, keepdims=True))
        e = z.copy()
        sums = op4._exponents(e)
        assert np.isfinite(e).all() and (sums > 0).all() and np.allclose(e / sums[:, None], want / want.sum(axis=1, keepdims=True), rtol=1e-3, atol=1e-6)
    assert op4._exponents(np.zeros((0, 15), np.float32)).shape == (0,)


def test_model_beats_unigrams_on_ordered_text(spark):
    rng = random.Random(2)
    cycle = words(rng, 12)
    text = [" ".join(cycle[(s + k) % 12] for k in range(200)) for s in (rng.randrange(12) for _ in range(150))]
    noise = [" ".join(rng.choice(cycle) for _ in range(200)) for _ in range(3)]
    df = frame(spark, [(i, t, "en", "s") for i, t in enumerate(text + noise)]).repartition(2)
    r = {x.doc_id: x.mean_log_prob for x in op4.score(df, rounds=3).collect()}
    good, bad = np.mean([r[i] for i in range(150)]), np.mean([r[i] for i in range(150, 153)])
    assert good > -math.log(12) + 0.5 and good > bad + 0.5


def test_default_training_does_not_depend_on_the_split(spark):
    rng = random.Random(3)
    cycle = words(rng, 12)
    text = [" ".join(cycle[(i + k) % 12] for k in range(400)) for i in range(300)] + [" ".join(rng.choice(cycle) for _ in range(400)) for _ in range(3)]
    df = frame(spark, [(i, t, "en", "s") for i, t in enumerate(text)])
    few, many = ({x.doc_id: x.mean_log_prob for x in op4.score(df.repartition(n)).collect()} for n in (1, 16))
    assert all(abs(few[i] - many[i]) < 1e-3 for i in few)
    good, bad = np.mean([many[i] for i in range(300)]), np.mean([many[i] for i in range(300, 303)])
    assert good > -math.log(12) + 0.5 and good > bad + 0.5


def test_every_token_has_a_probability_of_its_own(spark):
    rng = random.Random(8)
    common = [a + b for a in WORDS for b in WORDS][:1200]
    rare = ["zu" + w + w for w in WORDS] + ["qqqq", "zz"]
    rows = [" ".join(rng.choice(common) for _ in range(400)) for _ in range(20)] + [" ".join([*common[:5], w, *common[5:10]]) for w in rare]
    r = {x.doc_id: x.log_prob for x in op4.score(frame(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect()}
    assert len({round(r[20 + i], 6) for i in range(len(rare))}) > 0.9 * len(rare)
    assert op4.classes_for(0) == op4.CLASSES and op4.WIDTH * op4.classes_for(10**9) ** 3 > 16 * op4.VOCAB
    token = pa.array([b"ab", b"abc", b"b", b"cab"], pa.binary())
    pieces = pa.Table.from_batches(op4._pieces([pa.RecordBatch.from_arrays([token, pa.array([3, 2, 2, 1])], ["token", "n"])])).to_pandas()
    v = op4.Vocabulary(pa.table({"kind": [0], "h": [1], "rank": [1]}), pa.Table.from_pandas(pieces[pieces.kind == 0][["key", "n"]].groupby("key", as_index=False).sum()))
    text = [bytes(x) for n in range(1, 4) for x in itertools.product(b"abc", repeat=n)]
    off = np.concatenate(([0], np.cumsum([len(x) for x in text])))
    p = np.exp(v.spell(np.frombuffer(b"".join(text), np.uint8), off[:-1], off[1:], np.zeros(len(text), bool)))
    assert 0.4 < p.sum() < 1 and p[text.index(b"ab")] > p[text.index(b"bb")]


def plain_score(text, ranks, spelling, w, classes):
    """Log probability of a text by loops over its tokens, from the tables that training wrote."""
    vocab, words = op4.WIDTH * classes**3, op4.WIDTH * classes
    cut = np.cumsum([4 * (vocab + 1) * 16, 17 * classes, classes * 17 * classes])
    emb, cls, mid, out = np.split(w[: len(w) // 2].astype(float), cut)
    emb, cls, mid, out = emb.reshape(4, vocab + 1, 16), cls.reshape(17, classes), mid.reshape(classes, 17, classes), out.reshape(classes**2, 17, words)
    by = {(r["kind"], r["h"]): r["rank"] for r in ranks}
    tri = collections.Counter({(r["key"] >> 18, r["key"] >> 9 & 511, r["key"] & 511): r["n"] for r in spelling})
    bi, uni, ends = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, b, c), n in tri.items():
        bi[b, c] += n
        uni[c] += n
        ends[a, b] += n
    seen = {k for t in tri for k in t[2:]} | {256}
    kinds = len(seen) + 1

    def sign(a, b, c):
        a, b, known = (a if a in seen else -1), (b if b in seen else -1), c in seen
        p = (uni[c] + 1) / (sum(uni.values()) + kinds) if known else 1 / (sum(uni.values()) + kinds)
        p = ((bi[b, c] if known else 0) + 4 * p) / (sum(n for (x, _), n in bi.items() if x == b) + 4)
        p = ((tri[a, b, c] if known else 0) + 4 * p) / (ends[a, b] + 4)
        return p if known else p / max(1, 257 - len(seen))

    tokens = [t.encode() for t in re.findall(r"[0-9a-z_\x80-\U0010ffff]+|[^0-9a-z_\x80-\U0010ffff\s]+", text.lower())]
    ids, spelt = [], 0.0
    for t in tokens:
        k = tokenize(np.frombuffer(t, np.uint8), np.array([0, len(t)]), False)
        i = by.get((0, int(k.hash.view(np.int64)[0])), 0)
        if not i:
            i = by.get((1, int(op4._beginning(np.frombuffer(t, np.uint8), k.starts, k.ends).view(np.int64)[0])), 0)
            chars = [256, 256, *t, 256]
            skip = 0 if not i else 3 if len(t) >= 3 else len(t) + 1
            spelt += sum(math.log(sign(*chars[j : j + 3])) for j in range(skip, len(t) + 1))
        ids.append(i)
    total = spelt
    for j, i in enumerate(ids):
        x = np.zeros(16)
        for d in (1, 2):
            x += emb[2 * d - 2, ids[j - d] if j >= d else vocab] + emb[2 * d - 1, ids[j + d] if j + d < len(ids) else vocab]
        h = np.append(np.tanh(x), 1.0)
        group = i // words
        for weights, choice in ((cls, group // classes), (mid[group // classes], group % classes), (out[group], i % words)):
            z = h @ weights
            total += z[choice] - np.log(np.exp(z).sum())
    return len(ids), total


def test_score_against_plain_loops(spark):
    rng = random.Random(9)
    common = [a + b for a in WORDS for b in WORDS]
    rows = [" ".join(rng.choice(common) + rng.choice(["", ",", " ..."]) for _ in range(200)) for _ in range(30)] + ["Ein seltenes Wort: Zuckerr\u00fcbe! x", "ba", "\u65e5\u672c \x7f"]
    df = frame(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])
    vocab, classes, weights = op4.train(df)
    ranks, spelling = (spark.read.parquet(p).collect() for p in vocab)
    w = np.concatenate([np.array(r["w"], np.float32) for r in sorted(spark.read.parquet(weights).collect(), key=lambda r: r["block"])])
    got = {r.doc_id: r for r in op4.score(df).collect()}
    for i in (0, 30, 31, 32):
        n, total = plain_score(rows[i], ranks, spelling, w, classes)
        assert got[i].n_tokens == n and abs(got[i].log_prob - total) < 1e-3 * (1 + n)


def test_most_frequent_keys(spark):
    rng = random.Random(1)
    rows = [(rng.getrandbits(62), int(10 ** rng.uniform(0, 5))) for _ in range(2900)] + [(rng.getrandbits(62), n) for n in range(1000, 1100)]
    df = spark.createDataFrame(rows, "h long, n long")
    for size in (0, 5, 700, 1150, 1180, 2500, 5000):
        got = op4.most_frequent(df, "h", size)
        assert min(size, 3000) * 0.97 - 3 <= len(got) <= size
        left = {n for h, n in set(rows) - set(got)}
        assert not got or not left or got[-1][1] * 1.02 >= max(left)


def test_score_awkward(spark, awkward):
    r = op4.score(awkward).collect()
    assert len(r) == len(AWKWARD)
    by = {x.doc_id: x for x in r}
    assert (by[2].n_tokens, by[2].log_prob, by[2].mean_log_prob) == (0, 0.0, None) and by[1].mean_log_prob is None and by[5].n_tokens == 40_000
    assert op4.score(awkward.limit(0)).count() == 0


# 5 and 10 vectors
def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(e) for e in v], 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int")


ODD = [(901, None), (902, []), (903, [0.0] * 8), (904, [float("nan")] * 8), (905, [1.0, None] * 4), (906, [1.0, 2.0]), (None, [1.0] * 8)]


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((250, 24))
    near = base[rng.integers(0, 250, 150)] + rng.standard_normal((150, 24)) * 0.12
    x = np.concatenate([base, near, base[:20], np.repeat(base[:1], 60, axis=0)]).astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= op5.THRESHOLD, 1))
    got = {r.vec_id: r.group_id for r in op5.near_vectors(vectors(spark, x)).collect()}
    caught = sum(got.get(a, -1) == got.get(b, -2) for a, b in zip(i.tolist(), j.tolist()))
    assert len(i) > 100 and caught >= 0.9 * len(i)
    root = list(range(len(x)))
    for _ in range(50):
        for a, b in zip(i.tolist(), j.tolist()):
            root[a] = root[b] = min(root[a], root[b])
    assert all(root[v] == root[g] for v, g in got.items())


def test_near_vectors_in_a_dense_cloud(spark):
    rng = np.random.default_rng(5)
    n, dim, cos = 4000, 64, 0.88
    unit = lambda e: e / np.linalg.norm(e, axis=1, keepdims=True)
    x = unit(unit(rng.standard_normal((1, dim))) * cos**0.5 + rng.standard_normal((n, dim)) * ((1 - cos) / dim) ** 0.5)
    side = rng.standard_normal((200, dim))
    side = unit(side - (side * x[:200]).sum(axis=1, keepdims=True) * x[:200])
    got = {r.vec_id: r.group_id for r in op5.near_vectors(vectors(spark, np.concatenate([x, x[:200] * 0.955 + side * (1 - 0.955**2) ** 0.5]))).collect()}
    assert sum(got.get(i, -1) == got.get(n + i, -2) for i in range(200)) >= 190


def brute_top(x, ids, k, every):
    out = []
    for i in np.flatnonzero(ids % every == 0):
        s = np.round((x[i] * x).sum(axis=1), 6) + 0.0
        s[ids == ids[i]] = -np.inf
        best = np.lexsort((ids, -s))[: min(k, len(x) - 1)]
        out += [(int(ids[i]), int(ids[j]), float(s[j]), r + 1) for r, j in enumerate(best)]
    return sorted(out)


def test_top_k_against_sql(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((460, 8)).astype(np.float32)
    x[100:130] = x[50]
    df = vectors(spark, x)
    odd = spark.createDataFrame([(i, v, 0) for i, v in ODD], "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in op10.top_k(df.unionByName(odd), group_rows=50).select("query_id", "vec_id", "score", "rank").collect()]
    embeddings = df.toPandas()  # noqa: F841
    want = duckdb.sql(op10.ORACLE).fetchall()
    assert sorted(got) == sorted(want) and len(got) == 10 * 10


@pytest.mark.parametrize("rows", [7, 90, 10_000])
def test_top_k_against_brute_force(spark, rows):
    rng = np.random.default_rng(rows)
    base = rng.standard_normal((12, 16))
    x = (base[rng.integers(0, 12, 700)] + rng.standard_normal((700, 16)) * 0.2).astype(np.float32).astype(float)
    x[20:60] = x[7]
    ids = np.arange(-200, 500)
    got = sorted((r.query_id, r.vec_id, r.score, r.rank) for r in op10.top_k(vectors(spark, x, ids), k=5, every=3, group_rows=rows).collect())
    want = brute_top(x, ids, 5, 3)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 64))
    x = base[rng.integers(0, 40, 8000)] + rng.standard_normal((8000, 64)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(8000)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    g = op10.Group(x, ids, axes)
    a, b, s = op10.threshold_search(g, x[:64], ids[:64], 10)
    assert g.scored < 0.5 * 64 * 8000
    want = brute_top(x, ids, 10, 1)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(w[:2] for w in want if w[0] < 64)
    floor = np.array([min(w[2] for w in want if w[0] == i) for i in range(64)])
    far = op10.Group(x[4000:] * 0.2, ids[4000:], axes)
    assert not len(op10.threshold_search(far, x[:64], ids[:64], 10, floor)[0]) and far.scored == 0  # no access where the bound is below the floor
    even = rng.standard_normal((4000, 64))
    g = op10.Group(even, ids[:4000], None)
    op10.threshold_search(g, even[:16], ids[:16], 10)
    assert g.scored >= 16 * 4000  # without structure the bound stops nothing


def test_bound_holds():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 9)) * rng.random(9)
    g = op10.Group(x, np.arange(500), None)
    q = rng.standard_normal((40, 9))
    q[0, 3] = 0
    for depth in (0, 3, 40, 200, 499):
        top = g.bound(np.abs(q), g.caps(q, depth))[0]
        for i in range(40):
            shown = np.unique(np.concatenate([g.order[500 - depth :, j] if q[i, j] >= 0 else g.order[:depth, j] for j in range(9)])) if depth else np.zeros(0, int)
            rest = np.setdiff1d(np.arange(500), shown)
            assert not len(rest) or (x[rest] @ q[i]).max() <= top[i] + 1e-9


def test_vectors_awkward(spark):
    odd = spark.createDataFrame([(i, v, "x", 1) for i, v in ODD] + [(1, [1.0] * 8, "x", 1), (1, [1.0] * 8, "x", 1), (2, [2.0] * 8, "x", 1)], "vec_id long, embedding array<float>, pass string, id int")
    assert {(r.vec_id, r.group_id) for r in op5.near_vectors(odd).collect()} == {(1, 1), (2, 1)}
    assert sorted((r.query_id, r.vec_id, r.score) for r in op10.top_k(odd, every=1).collect()) == [(1, 2, 16.0), (2, 1, 16.0)]
    assert op10.top_k(odd).count() == 0
    assert op5.near_vectors(odd.limit(0)).count() == 0 and op10.top_k(odd.limit(0)).count() == 0


# 6 BPE
def test_bpe_is_the_reference_encoding(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(op6.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pat = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", "aaaaaaaaaaaaaaaaa aaaa", " \n\n  x\t", "don't we'll I'M 12345 $$$ ...", "日本語 é 🎉🎉 ñandú", "<|endoftext|>", "x" * 5000] + ["".join(rng.choice("abc é'\n.1 ") for _ in range(rng.randrange(200))) for _ in range(200)] + [" ".join(words(rng, 50)) for _ in range(50)]
    df = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    out = op6.encode(df, verify=True)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].tokens == enc.encode_ordinary(t) and got[i].n_tokens == len(got[i].tokens) and got[i].round_trip for i, t in enumerate(texts))
    assert all(r.decoded == texts[r.doc_id] for r in op6.decode(out).collect())


def test_bpe_awkward(awkward):
    out = op6.encode(awkward, verify=True).collect()
    assert len(out) == len(AWKWARD)
    assert [(r.tokens, r.n_tokens, r.round_trip) for r in out if r.doc_id == 1] == [(None, None, None)] and [r.tokens for r in out if r.doc_id == 2] == [[]]
    assert all(r.round_trip for r in out if r.text is not None) and all(r.rid == "clash" for r in out)
    assert op6.encode(awkward.limit(0)).count() == 0


def test_decode_of_ids_that_are_none(spark):
    cat = op6.bpe(op6.RANKS).encode(["cat"])[0].tolist()
    rows = [(1, cat), (2, [50_000_000, *cat, -1, None]), (3, None), (4, []), (5, [None]), (6, cat * 400_000)]
    got = {r.doc_id: r.decoded for r in op6.decode(spark.createDataFrame(rows, "doc_id long, tokens array<int>").withColumn("decoded", F.lit(7))).collect()}
    assert got == {1: "cat", 2: "\ufffdcat\ufffd\ufffd", 3: None, 4: "", 5: "\ufffd", 6: "cat" * 400_000}


# 7 Kneser-Ney
def brute_kn(sents, text):
    """Interpolated modified Kneser-Ney by dictionaries."""
    tri, bi, uni = collections.Counter(), collections.Counter(), collections.Counter()
    vocab = {w for s in sents for w in s}
    for s in sents:
        tri.update(zip(s, s[1:], s[2:]))
    bi.update((v, w) for _, v, w in tri)
    uni.update(w for _, w in bi)
    for w in vocab:
        uni.setdefault(w, 1)

    def disc(c):
        n = collections.Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]

    def level(c):
        d = disc(c)
        total, held = collections.Counter(), collections.Counter()
        for k, n in c.items():
            ctx = k[:-1] if isinstance(k, tuple) else ()
            total[ctx] += n
            held[ctx] += d[min(n, 3) - 1]
        return d, total, held

    levels = {3: (tri, *level(tri)), 2: (bi, *level(bi)), 1: (uni, *level(uni))}

    def p(k):
        c, d, total, held = levels[len(k)]
        ctx = k[:-1]
        key = k if len(k) > 1 else k[0]
        if len(k) == 1:
            lower = 1 / (len(vocab) + 1)
        else:
            lower = p(k[1:])
        if not total[ctx]:
            return lower
        n = c.get(key, 0)
        return (max(n - d[min(n, 3) - 1], 0) / total[ctx] if n else 0) + held[ctx] / total[ctx] * lower

    return sum(-math.log2(p(tuple(text[max(0, i - 2) : i + 1]))) for i in range(len(text))) / len(text)


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(12)
    sents = [[rng.choice("abcdefg") + rng.choice("xy") for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    path = op7.fit(spark.createDataFrame([(" ".join(s).upper(),) for s in sents], "text string"))
    tests = [["ax", "by", "new", "cx"], ["zz"], ["ax"] * 6, sents[0]]
    r = {x.doc_id: x.surprisal for x in op7.perplexity(frame(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(tests)]), path).collect()}
    for i, t in enumerate(tests):
        assert abs(r[i] - brute_kn(sents, t)) < 1e-4


def test_order_by_range():
    rng = np.random.default_rng(12)
    key = rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64)
    for q in (np.concatenate([key, key[:900], key[:50] ^ np.uint64(1), np.array([0, 2**64 - 1], np.uint64)]), key[:1], key[:0]):
        order = op7._by_range(q)
        assert (np.sort(order) == np.arange(len(q))).all()
        for n in (1, 3, 103, 1 << op7.RANGE_BITS):
            of = op7._range(q[order], n)
            assert (of[1:] >= of[:-1]).all()


def test_shards_read_one_by_one_score_the_same(spark, monkeypatch):
    rng = random.Random(2)
    text = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in text], "text string")
    whole = op7.Model(op7.fit(df))
    monkeypatch.setattr(op7, "SHARD_ROWS", 100)
    monkeypatch.setattr(op7, "KEPT_ROWS", 0)
    cut = op7.Model(op7.fit(df))
    assert whole.keep and not cut.keep and len(cut.files[3]) > 10 and whole.held and not cut.held
    t = tokenize(*flat(pa.array([*text[:9], "new word", ""])), False)
    assert np.allclose(whole.log2(t.hash, t.row_of()), cut.log2(t.hash, t.row_of()), atol=1e-6)


def test_a_block_does_not_read_the_whole_model(spark, monkeypatch):
    monkeypatch.setattr(op7, "SHARD_ROWS", 100)
    monkeypatch.setattr(op7, "KEPT_ROWS", 0)
    rng = random.Random(3)
    text = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(80)]
    path = op7.fit(spark.createDataFrame([(t,) for t in text], "text string"))
    mapped, read = op7.Model(path), op7.Model(path)
    read.fs = pa.fs.SubTreeFileSystem("/", pa.fs.LocalFileSystem())  # one whose files can't be mapped
    for k, tables in op7.TABLES.items():
        for name in tables:
            for one, again, other in zip(mapped.shards(k, name), mapped.shards(k, name), read.shards(k, name)):
                one, again, other = (x if k == 1 else x[1] for x in (one, again, other))
                assert all(np.shares_memory(a, b) and (a == c).all() for a, b, c in zip(one, again, other))
    t = tokenize(*flat(pa.array([*text[:9], "new word", ""])), False)
    assert (mapped.log2(t.hash, t.row_of()) == read.log2(t.hash, t.row_of())).all() and mapped.maps and not read.maps
    own = []
    monkeypatch.setattr(op7, "model", lambda path: own.append(mapped) or mapped)
    assert sum(b.num_rows for b in op7._score(path, 1)(iter([pa.RecordBatch.from_arrays([pa.array(text)], ["text"])]))) == 80 and own and not mapped.maps


def test_no_trusted_document_is_left_out(spark):
    n = 2600
    lab = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    path, trusted, sample = op7.train(frame(spark, [(i, f"w{i} and more", "en", "s") for i in range(n)]), lab)
    fitted, m = {r.doc_id for r in sample.collect()}, op7.Model(path)
    t = tokenize(*flat(pa.array([f"w{i}" for i in range(n)])), False)
    known = np.isin(t.hash.view(np.int64), np.concatenate([s[0] for s in m.shards(1)]))
    assert set(np.flatnonzero(known)) == fitted and 1200 < len(fitted) < 1400 and trusted.count() == n


def test_counting_in_pieces_against_brute_force(spark, monkeypatch):
    for name, v in (("SHARD_ROWS", 60), ("KEPT_ROWS", 0), ("COUNT_TOKENS", 50), ("BLOCK_TOKENS", 40)):
        monkeypatch.setattr(op7, name, v)
    rng = random.Random(15)
    sents = [[rng.choice("abcdefg") + rng.choice("xyz") for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    path = op7.fit(spark.createDataFrame([(" ".join(s),) for s in sents], "text string").repartition(3))
    tests = [["ax", "by", "new", "cx"], ["zz"], [], sents[0], sents[1] + sents[2]]
    r = {x.doc_id: x.surprisal for x in op7.perplexity(frame(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(tests)]), path).collect()}
    assert r[2] is None and all(abs(r[i] - brute_kn(sents, t)) < 1e-4 for i, t in enumerate(tests) if t) and len(op7.Model(path).files[2]) > 2


def test_classifier_leaves_no_tables_behind(spark, labels):
    folder = shared_dir(spark).removeprefix("file:") + "/argosec"
    text = [(i, f"some words {i} here {i % 7} and there", "en", "s") for i in range(50)]
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    op7.fit(frame(spark, text))
    assert [n.split("-")[0] for n in set(os.listdir(folder)) - before] == ["kneser"]
    before = set(os.listdir(folder))
    assert op7.classify(frame(spark, text), labels).count() == op7.keep_good(frame(spark, text), labels).count() == 50
    assert not [n for n in set(os.listdir(folder)) - before if n.startswith(("kneser", "grams", "words"))]


def test_counting_and_scoring_take_little_beside_the_tokens(spark, monkeypatch):
    rng = np.random.default_rng(8)
    text = [" ".join(f"w{i}" for i in rng.integers(0, 30_000, 500)) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(text)], ["text"])
    monkeypatch.setattr(op7, "COUNT_TOKENS", 500_000)
    monkeypatch.setattr(op7, "BLOCK_TOKENS", 500_000)
    path = op7.fit(spark.createDataFrame([(t,) for t in text[:2]], "text string"))
    for run, most in ((op7._count_grams(4, 2, False), 220), (op7._count_grams(4, 2, True), 220), (op7._score(path, 1), 115)):
        textvec._CACHE.clear()
        tracemalloc.start()
        n = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n and peak < most * 500_000, peak / 500_000  # bytes a token


def test_lean_worker_gives_memory_back():
    class Held:
        pass

    held = Held()
    held.me, gone = held, weakref.ref(held)
    shared.keep("other", "held", 1, lambda: held)
    del held
    used = lambda: sum(map(int, re.findall(r"\n(?:Pss_Anon):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
    pins = []

    def run(batches):
        for b in batches:
            rows = [np.ones(12_000) for _ in range(2000)]  # 192 MB, in parts below the size that the system gets back at once
            pins.extend(rows[::100])
            yield b

    before = used()
    assert list(shared.lean("own", run)(iter([1]))) == [1] and gone() is None
    assert used() < before + 60 and len(pins) == 20


def test_packed_columns():
    rng = np.random.default_rng(4)
    for cols in ([rng.integers(0, 2**64, 999, dtype=np.uint64), np.arange(999)], [np.zeros(0, np.int64)], [np.array([0, 255]), np.array([256, 65536]), np.array([2**32, 1])]):
        got = op7._unpack(op7._pack(*cols))
        assert all((g == c.astype(np.uint64)).all() and len(g) == len(c) for g, c in zip(got, cols)) and len(got) == len(cols)


def test_decisions_belong_to_rows(spark):
    rng = random.Random(3)
    vocab = words(rng, 80)
    text = lambda: " ".join(rng.choice(vocab) for _ in range(80))
    junk = " | ".join(rng.choice(WORDS) + rng.choice(WORDS) + "q" for _ in range(80))
    rows = [(i, text(), "en", "s") for i in range(400)] + [(None, text(), "en", "s"), (None, junk, "en", "s"), (7000, text(), "en", "s"), (7000, junk, "en", "s")]
    lab = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = op7.keep_good(frame(spark, rows).withColumn("__n", F.lit(1)), lab, max_train_docs=100)
    assert got.columns[-1] == "__n" and not got.where(F.col("text") == junk).count()
    assert {str(r.doc_id) for r in got.collect()} >= {"None", "7000"}
    odd = frame(spark, rows).withColumn("text", F.encode("text", "UTF-8"))
    assert op7.keep_good(odd, lab, max_train_docs=100).schema["text"].dataType.simpleString() == "binary"


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(3)
    vocab = words(rng, 80)
    good = [(i, " ".join(rng.choice(vocab) for _ in range(80)), "en", "s") for i in range(400)]
    bad = [(1000 + i, " | ".join(rng.choice(WORDS) + rng.choice(WORDS) + "q" for _ in range(80)), "en", "s") for i in range(60)]
    lab = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    r = {x.doc_id: x.keep for x in op7.classify(frame(spark, good + bad), lab, max_train_docs=100).collect()}
    assert np.mean([r[i] for i in range(300, 400)]) >= 0.97 and not any(r[1000 + i] for i in range(60))
    assert op7.keep_good(frame(spark, good + bad), lab, max_train_docs=100).count() == sum(r.values())


def test_classifier_awkward(awkward, labels):
    r = op7.classify(awkward, labels).collect()
    assert len(r) == len(AWKWARD)
    by = {x.doc_id: x for x in r}
    assert not by[1].keep and by[1].perplexity is None and not by[2].keep and by[5].perplexity > 0
    assert op7.keep_good(awkward, labels).columns == awkward.columns
    none = op7.classify(awkward, labels.limit(0)).collect()
    assert {x.keep for x in none if x.n_tokens} == {True} and op7.classify(awkward.limit(0), labels).count() == 0


# 8 WARC
@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(tmp_path, zipped):
    rng = random.Random(1)
    put = op8.member if zipped else (lambda b: b)
    recs = [op8.record(str(i), f"http://a/{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(1, 3000))) + b"WARC/1.0 x") for i in range(40)]
    out, keep, bad = b"", [], 0
    for i, r in enumerate(recs):
        b = put(r)
        if i % 7 == 3:
            b = b[: len(b) // 2]
        elif i % 7 == 5:
            b = b + b"\x1f\x8b\x08 rubbish WARC/1.0\r\n"
            keep.append(i)
        elif i % 7 == 6:
            k = len(b) // 2
            b = b[:k] + bytes(255 - c for c in b[k : k + 9]) + b[k + 9 :]
        else:
            keep.append(i)
        bad += len(b) if i % 7 in (3, 6) else 0
        out += b
    f = tmp_path / "x.warc"
    f.write_bytes(out)
    for span in (len(out) + 1, 1500):
        rows = []
        with open(f, "rb") as fh:
            for a in range(0, len(out), span):
                rows += list(op8.salvage(op8.Source(fh, len(out)), a, min(a + span, len(out))))
        rows = [r for r in rows if r["kind"] != "range"]
        ids = [int(r["record_id"]) for r in rows if r["kind"] == "record"]
        assert sorted(ids) == keep
        covered = sorted((r["offset"], r["offset"] + r["size"]) for r in rows)
        if span > len(out):
            assert covered[0][0] == 0 and covered[-1][1] == len(out) and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
            assert all(r["reason"] for r in rows if r["kind"] == "gap")


def raw_record(block, *lines, end=b"\r\n"):
    return end.join([b"WARC/1.1", *(x.encode() for x in lines), b"Content-Length: %d" % len(block)]) + end * 2 + block + end * 2


def test_records_as_public_files_have_them():
    block = b"some text \x00 here"
    sha = hashlib.sha1(block).digest()
    for d in (f"sha1:{base64.b32encode(sha).decode()}", f"SHA1:{sha.hex().upper()}", f"sha-256:{hashlib.sha256(block).hexdigest()}", f"md5:{base64.b32encode(hashlib.md5(block).digest()).decode().rstrip('=')}", f"sha512:{hashlib.sha512(block).hexdigest()}"):
        head, got, _ = op8.parse(raw_record(block, f"WARC-Block-Digest: {d}"))
        assert got == block and "unchecked" not in head
        assert op8.parse(raw_record(block + b"x", f"WARC-Block-Digest: {d}")) == "digest differs"
    head, _, end = op8.parse(raw := raw_record(block, "WARC-Target-URI: http://a/", "\tb c", "  d", "WARC-Block-Digest: blake3:00"))
    assert head["warc-target-uri"] == "http://a/ b c d" and head["unchecked"] == "digest not checked: blake3" and end == len(raw)
    assert op8.parse(raw_record(block, " folded first")) == "bad header line" and op8.parse(raw_record(block, "WARC-Block-Digest: sha1:zz")) == "digest differs"
    assert op8.parse(raw_record(block, end=b"\n"))[1] == block


def test_rows_do_not_depend_on_the_ranges(spark, tmp_path):
    rng = random.Random(4)
    some = lambda i, n=300: op8.record(f"{i}", f"http://a/{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(1, n))))
    inner = b"".join(some(f"in{i}") for i in range(40))
    stored = b"".join(zlib.compress(some(f"z{i}"), 1, 31) for i in range(30))
    hold = zlib.compressobj(0, zlib.DEFLATED, 31)
    plain = [some(i) for i in range(30)]
    plain[5], plain[12], plain[20] = op8.record("outer", "u", inner), plain[12][:-9], plain[20] + b"rubbish " * 400
    (tmp_path / "a.warc").write_bytes(b"".join(plain))
    zipped = [op8.member(some(i)) for i in range(30)]
    zipped[3] = hold.compress(op8.record("outer", "u", stored)) + hold.flush()
    zipped[9] = op8.member(some("m1") + some("m2") + some("m3")[:-3] + some("m4"))
    zipped[15] = zipped[15][:-7] + b"\x1f\x8b\x08 no member"
    (tmp_path / "b.warc.gz").write_bytes(b"".join(zipped))
    (tmp_path / "c.warc").write_bytes(b"")
    got = [sorted(str(r) for r in op8.read_warc(spark, str(tmp_path), n).collect()) for n in (700, 1024, 1 << 23)]
    assert got[0] == got[1] == got[2]
    rows = op8.read_warc(spark, str(tmp_path), 1024).collect()
    ids = [r.record_id for r in rows if r.kind == "record" and r.file == "a.warc"]
    assert sorted(ids) == sorted(["outer", *(str(i) for i in range(30) if i not in (5, 12))])
    ids = [r.record_id for r in rows if r.kind == "record" and r.file != "a.warc"]
    assert sorted(ids) == sorted(["outer", "m1", "m2", "m4", *(str(i) for i in range(30) if i not in (3, 9, 15))])
    for name in ("a.warc", "b.warc.gz"):
        at = sorted((r.offset, r.offset + r.size) for r in rows if r.file == name and r.size and not r.inner)
        assert at[0][0] == 0 and at[-1][1] == (tmp_path / name).stat().st_size and all(x[1] == y[0] for x, y in zip(at, at[1:]))


def test_warc_round_trip(spark):
    rows = [(i, f"http://p/{i}", "é" * i + "<p>") for i in range(300)] + [(None, "u", "x"), (1000, None, None), (1001, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = op8.round_trip(pages).collect()
    lost = {p for p in (r[0] for r in rows) if int(__import__("hashlib").md5(str(p).encode()).hexdigest()[:8], 16) % 150 < 2}
    recs = {r.page_id: r for r in got if r.kind == "record" and r.page_id is not None}
    assert set(recs) == {r[0] for r in rows if r[0] is not None} - lost
    assert all(recs[i].html == (h or "") and recs[i].url == u for i, u, h in rows if i in recs)
    assert all(r.file and r.offset is not None and r.gap_bytes for r in got if r.kind == "gap") and any(r.kind == "gap" for r in got)
    clash = pages.limit(5).union(pages.limit(5)).withColumn("kind", F.lit(1)).withColumn("file", F.lit("x"))
    assert op8.round_trip(clash).where("kind = 'record'").count() == 10 and op8.round_trip(pages.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "u", "y" * 3_000_000)], "page_id long, url string, html string")
    assert [len(r.html) for r in op8.round_trip(long).collect()] == [3_000_000]


@pytest.mark.parametrize("raw", [b"", b"\x00" * 50, b"junk", b"WARC/1.0\r\n", b"WARC/1.0\r\nContent-Length: 99\r\n\r\nx", b"\x1f\x8b\x08"])
def test_salvage_of_rubbish(tmp_path, raw):
    f = tmp_path / "r.warc"
    f.write_bytes(raw)
    with open(f, "rb") as fh:
        rows = [r for r in op8.salvage(op8.Source(fh, len(raw)), 0, len(raw)) if r["kind"] != "range"]
    assert [(r["kind"], r["offset"], r["size"]) for r in rows] == ([("gap", 0, len(raw))] if raw else [])


# 9 chat
def test_chat_against_sql(spark):
    rng = random.Random(4)
    rows = []
    for c in range(40):
        base = [(k, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "", None])) for k in range(rng.randrange(1, 5))]
        for cut in {len(base), rng.randrange(1, len(base) + 1)}:
            rows += [(c * 10 + cut, *t) for t in base[:cut]]
    rows += [(None, 0, "user", "x"), (999, None, None, None), (999, 1, "user", "b"), (998, 0, "user", "user"), (997, 0, None, "user")] + rows[:5]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hashes", F.lit(1)).withColumn("last", F.lit("clash"))
    got = sorted(tuple(r) for r in op9.render(df).collect())
    con = duckdb.connect()
    con.register("conversations", conversations)
    assert got == sorted(con.execute(op9.ORACLE).fetchall())
    assert op9.render(df.limit(0)).count() == 0


def test_chat_keeps_maximal_ones(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "b")]
    got = {r.conv_id: r.rendered for r in op9.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {2: "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n", 3: "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"}
