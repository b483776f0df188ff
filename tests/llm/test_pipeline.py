"""The pipeline's stages take effect on planted cases and survive awkward rows."""

import base64
import collections
import glob
import math
import os
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from argosec.llm import op01_repeats as op1
from argosec.llm import op02_cube as op2
from argosec.llm import op03_simhash as op3
from argosec.llm import op06_bpe as op6
from argosec.llm import op07_kneser_ney as op7
from argosec.llm import queries
from argosec.llm.shared import shared_dir, stash
from argosec.llm.textvec import flat

from .test_operators import AWKWARD, DOCS, WORDS, brute_cube, brute_groups, brute_kn, frame, maximal_repeats, words


def planted(rng):
    vocab = words(rng, 400)
    good = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, good(120), "en", "ab"[i % 2]) for i in range(300)]
    passage = good(60)
    rows += [(1000 + i, good(40) + " " + passage + " " + good(40), "en", "a") for i in range(8)]
    near = rows[0][1].split()
    near[7], near[50] = "changed", "words"
    rows += [(2000, rows[1][1], "en", "a"), (2001, " ".join(near), "en", "b")]
    rows += [(3000 + i, " | ".join(rng.choice(WORDS) + rng.choice(WORDS) + "zz" for _ in range(100)), "en", "a") for i in range(20)]
    return rows, passage


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    rows, passage = planted(rng)
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(250)] + [(3000 + i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    for name, stage in cp.STAGES:
        docs = stash(stage(spark, docs, str(tmp_path)), "t")
        seen.append({r.doc_id: r for r in docs.collect()})
        if name != cp.STAGES[-1][0]:
            assert docs.dtypes == frame(spark, []).dtypes
    good, single, cut, mixed, tokens = seen
    assert not [i for i in good if i >= 3000] and len([i for i in good if i < 300]) >= 285
    assert 2000 not in single and 2001 not in single and {0, 1} <= set(single) and len(good) - len(single) == 2
    holders = [i for i, r in cut.items() if passage in r.text]
    assert len(holders) == 1 and holders[0] == min(i for i in single if i >= 1000) and set(cut) == set(single)
    assert all(cut[i].text == single[i].text for i in cut if i < 300)
    assert 0 < len(mixed) <= len(cut) and set(tokens) == set(mixed) and all(r.n_tokens == len(r.tokens) > 0 for r in tokens.values())
    again = {r.doc_id: (r.n_tokens, tuple(r.tokens)) for r in cp.run(spark, str(tmp_path)).collect()}
    assert again == {i: (r.n_tokens, tuple(r.tokens)) for i, r in tokens.items()}


def brute_pipeline(spark, rows, labels):
    """Tokens by doc_id: every stage by plain loops over all rows, with the sample of op7 and the hashes of op2 taken from Spark."""
    tiktoken = pytest.importorskip("tiktoken")
    pat = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(op6.RANKS, "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    docs = {i: (t, lang, src) for i, t, lang, src in rows}
    # 1: surprisal of each document under the sample's model, against the largest one of trusted documents outside the sample
    _, trusted, sample = op7.train(frame(spark, rows), labels)
    trusted, sample = {r.doc_id for r in trusted.collect()}, {r.doc_id for r in sample.collect()}
    cut = {i: re.findall(r"[0-9a-z_]+|[^0-9a-z_\s]+", t.lower()) for i, (t, _, _) in docs.items()}
    s = {i: brute_kn([cut[j] for j in sample], w) - op7.SLACK / math.sqrt(len(w)) for i, w in cut.items()}
    held = sorted(s[i] for i in trusted - sample)
    assert op7.LEAST > len(held) > 10  # so the threshold is that of all languages
    limit = held[math.ceil(op7.QUANTILE * len(held)) - 1]
    docs = {i: d for i, d in docs.items() if s[i] <= limit}
    # 2: the least id of each group of fingerprints that are near, over all pairs
    fp, _ = op3.fingerprints(*flat(pa.array([t.lower() for t, _, _ in docs.values()])))
    root = brute_groups(list(docs), fp, op3.MAX_DISTANCE)
    docs = {i: d for i, d in docs.items() if root[i] == i}
    # 3: every place of a maximal repeat but the first is cut out
    words_of = {i: t.split(" ") for i, (t, _, _) in docs.items()}
    gone = collections.defaultdict(set)
    for k, places in maximal_repeats(words_of, op1.MIN_WORDS).items():
        for d, at in places[1:]:
            gone[d] |= set(range(at, at + len(k)))
    text = {i: "".join(w + " " * (j + 1 < len(ws)) for j, w in enumerate(ws) if j not in gone[i]) for i, ws in words_of.items()}
    docs = {i: (text[i], *d[1:]) for i, d in docs.items() if text[i].strip()}
    # 4: the cube
    df = frame(spark, [(i, *d) for i, d in docs.items()])
    ident = df.select("doc_id", "source", op2._row(op2.SEED).alias("row"))
    number = {r.row: r.draw for r in op2._redraw(ident, op2.SEED, 0).collect()}
    row = {r.doc_id: r.row for r in ident.collect()}
    total = collections.Counter()
    for i, d in docs.items():
        total[d[2]] += len(d[0].split())
    weight = {k: n**op2.TEMPERATURE for k, n in total.items()}
    budget = min(total[k] / weight[k] for k in total)
    taken = set()
    for k in total:
        pi = min(1.0, budget * weight[k] / total[k])
        own = [(row[i], 1, len(d[0].split()), 0) for i, d in docs.items() if d[2] == k]
        taken |= {u[0] for u in own} if pi > 1 - 1e-9 else brute_cube(own, op2.SEED, op2.FLIGHT_ROWS, pi, lambda r, level: number[r])
    # 5
    return {i: tuple(enc.encode_ordinary(d[0])) for i, d in docs.items() if row[i] in taken}


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    vocab = words(rng, 150)
    good = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = good(55)
    rows = [(i, good(rng.randrange(40, 75)), "en", "abb"[i % 3]) for i in range(110)] + [(300 + i, good(5 + i) + " " + passage + " " + good(6), "en", "a") for i in range(4)]
    rows += [(400, rows[1][1], "en", "a"), (401, rows[2][1].replace(" ", ", ", 1), "en", "b"), (402, passage, "en", "b")] + [(500 + i, " | ".join(rng.choice(WORDS) + rng.choice(WORDS) + "zz" for _ in range(60)), "en", "a") for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(500, 0, 0)], "doc_id long, quality int, toxic int")
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    want = brute_pipeline(spark, rows, labels)
    got = {r.doc_id: tuple(r.tokens) for r in cp.run(spark, str(tmp_path)).collect()}
    assert got == want and 40 < len(want) < len(rows) - 8


def test_near_duplicates_without_a_common_anchor(spark, tmp_path):
    rng = random.Random(6)
    vocab = words(rng, 3000)
    rows = []
    for i in range(0, 800, 2):
        w = rng.sample(vocab, 60)
        rows += [(i, " ".join(w), "en", "s"), (i + 1, " ".join(w[:54] + rng.sample(vocab, 6)), "en", "s")]
    fp, _ = op3.fingerprints(*flat(pa.array([r[1] for r in rows])))
    met = [{(j, int(a)) for j in range(op3.BLOCKS) for a in op3.anchors((f[j // 2 :][:1] >> (31 * (j % 2))) & (2**31 - 1))[1]} for f in fp]
    assert [i for i in range(0, 800, 2) if op3.distance(fp[i], fp[i + 1]) <= op3.MAX_DISTANCE and not met[i] & met[i + 1]]
    root = brute_groups(list(range(800)), fp, op3.MAX_DISTANCE)
    got = {r.doc_id for r in cp.near_duplicates(spark, frame(spark, rows), str(tmp_path)).collect()}
    assert got == {i for i in range(800) if root[i] == i}


def test_run_leaves_its_result_only(spark, tmp_path):
    frame(spark, planted(random.Random(9))[0]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder = shared_dir(spark).removeprefix("file:") + "/argosec"
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    out = cp.run(spark, str(tmp_path))
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before] == ["bpe-encoding"] and out.count() > 0


def test_writing_removes_shuffle_files(spark):
    files = lambda: [f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in glob.glob(d + "/*/shuffle_*")]
    before = set(files())
    stash(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count().repartition(2), "t")
    for _ in range(50):
        if not set(files()) - before:
            break
        time.sleep(0.1)
    assert not set(files()) - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_awkward_rows(spark, tmp_path):
    docs = frame(spark, AWKWARD)
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clash = docs.withColumn("__rid", F.lit(1)).withColumn("keep", F.lit(True)).withColumn("row", F.lit(2)).withColumn("tokens", F.lit("x")).withColumn("n_tokens", F.lit("y"))
    for d in (docs, docs.limit(0), clash.drop("__rid")):
        seen = [d.collect()]
        for _, stage in cp.STAGES:
            d = stash(stage(spark, d, str(tmp_path)), "t")
            seen.append(d.collect())
        assert "tokens" in d.columns and "text" not in d.columns
        if seen[0]:
            good, single, cut, mixed, tokens = seen[1:]
            assert {(r.doc_id, (r.text or "")[:3]) for r in good} >= {(5, "x x"), (8, "two"), (None, "som")} and not [r for r in good if not (r.text or "").strip()]
            assert len([r for r in single if r.doc_id == 5]) == 1 and len([r for r in single if r.text == "one"]) == 1  # repeated rows and copies
            assert {r.doc_id for r in cut} == {r.doc_id for r in single} and len(tokens) == len(mixed) <= len(cut)


def test_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert set(queries.ORACLE) <= set(names) and DOCS
