"""LM scoring by masked pseudo-likelihood.

A bidirectional window network in numpy predicts every word of a text from the two words on each
side of it; the sum of the log probabilities of all words, each given the others, scores the document.

Vocabulary: its size is the square root of the number of tokens, VOCAB at least. Three quarters of it are the
most frequent tokens (lower-cased words and runs of signs), counted over all documents. The rest are the most frequent
beginnings (of up to PREFIX bytes) of all other tokens: the network predicts the beginning of such a token and sees it as context,
and byte trigrams, counted over those tokens, give the probability of its other bytes and of its end; a token without a known beginning
is class 0 and spelt whole. So every token has a probability of its own. Network:
h = tanh(sum over the four places of an embedding of the word there), then a softmax over
classes of words, one over the groups of the class and one over the words of the group (by rank; WIDTH times as many words as groups or classes).

Training covers all documents: LANES nets at most train side by side by AdaGrad, each on its share of the documents, and in each of
`rounds` passes over the corpus they are averaged, weighted by tokens, several times, more often the larger the corpus. Weights and the
sums of squares go on from the average. The number of nets is fixed, so a larger corpus trains each of them longer; documents are
dealt and ordered by hash, so scores don't depend on how the input is split. The driver only sees the path of the weights.

Defined results: (doc_id, n_tokens, log_prob, mean_log_prob) for every row with natural
logarithms; null, empty or token-less texts have n_tokens 0, log_prob 0 and a null mean; places beyond
the ends of a text hold a border sign; texts of any length are scored whole; repeated rows are trained on and scored each; tokens of equal count
are ranked by their hash; a doc_id, which is carried along only, is an integer (what cannot be read as one counts as null); extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosec.llm.shared import keep, new_path, stash, worker_table
from argosec.llm.textvec import HashIndex, chunks, flat, mix64, tokenize

CLASSES, WIDTH, DIM, SIDE = 7, 4, 16, 2
VOCAB = WIDTH * CLASSES**3
PREFIX, END, PRIOR = 3, 256, 4.0
RATE, BATCH, SEED = 0.1, 8192, 3
LARGE = 60  # exponents up to it and their sums are well within float32
LANES, LANE_TOKENS, PARTS = 12, 131_072, 4


class Net:
    """Weights as one float32 vector, with views by part: embeddings, and softmaxes over classes, over the groups of a class and over the words of a group."""

    def __init__(self, w: np.ndarray | None = None, classes: int = CLASSES):
        self.classes, self.words, self.vocab = classes, WIDTH * classes, WIDTH * classes**3
        shapes = [(2 * SIDE * (self.vocab + 1), DIM), (DIM + 1, classes), (classes, DIM + 1, classes), (classes * classes, DIM + 1, self.words)]
        size = [int(np.prod(s)) for s in shapes]
        if w is None:
            w = np.random.default_rng(SEED).standard_normal(sum(size)).astype(np.float32) * 0.1
        self.w = w
        self.emb, self.cls, self.mid, self.out = (p.reshape(s) for p, s in zip(np.split(w, np.cumsum(size)[:-1]), shapes))

    @staticmethod
    def context(ids: np.ndarray, row: np.ndarray, vocab: int = VOCAB) -> np.ndarray:
        """(2 * SIDE, tokens): row of the embedding table for each place around each token."""
        n = len(ids)
        out = np.full((2 * SIDE, n), vocab, np.int64)
        for j in range(SIDE):
            d = j + 1
            if n > d:
                same = row[d:] == row[:-d]
                out[2 * j, d:] = np.where(same, ids[:-d], vocab)
                out[2 * j + 1, :-d] = np.where(same, ids[d:], vocab)
        return out + np.arange(2 * SIDE)[:, None] * (vocab + 1)

    def hidden(self, ctx: np.ndarray) -> np.ndarray:
        h = np.ones((ctx.shape[1], DIM + 1), np.float32)
        x = self.emb.take(ctx[0], axis=0)
        for at in ctx[1:]:
            x += self.emb.take(at, axis=0)
        np.tanh(x, out=h[:, :DIM])
        return h

    def forward(self, ids: np.ndarray, ctx: np.ndarray):
        """Order by group, hidden layer, for each level (choice of each token, exponents, their sums, nodes, their borders) and the log probability, all in that order."""
        order = np.argsort(_narrow(ids // self.words, self.classes**2), kind="stable")
        x = ids[order]
        group = x // self.words
        h = self.hidden(ctx[:, order])
        i = np.arange(len(ids))
        levels, total = [], np.zeros(len(ids), np.float32)
        for node, choice, weights in ((None, group // self.classes, self.cls), (group // self.classes, group % self.classes, self.mid), (group, x % self.words, self.out)):
            if node is None:
                nodes, cut, z = None, None, h @ weights
            else:
                first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
                nodes, cut, z = node[first], np.append(first, len(x)).tolist(), np.empty((len(x), weights.shape[2]), np.float32)
                for k, a, b in zip(nodes.tolist(), cut, cut[1:]):
                    np.matmul(h[a:b], weights[k], out=z[a:b])
            sums = _exponents(z)
            total += np.log(z.ravel().take(i * z.shape[1] + choice) / sums + 1e-30)
            levels.append((choice, z, sums, nodes, cut))
        return order, h, levels, total

    def step(self, ids: np.ndarray, ctx: np.ndarray, g2: "Net", rate: float) -> None:
        """One AdaGrad step on the mean log loss."""
        order, h, levels, _ = self.forward(ids, ctx)
        n, i = len(ids), np.arange(len(ids))
        back, part = np.zeros((n, DIM + 1), np.float32), np.empty((n, DIM + 1), np.float32)
        for (choice, p, sums, nodes, cut), w, sq in zip(levels, (self.cls, self.mid, self.out), (g2.cls, g2.mid, g2.out)):
            p *= (1 / (sums * np.float32(n)))[:, None]
            p.reshape(-1)[i * p.shape[1] + choice] -= np.float32(1 / n)
            if nodes is None:
                back += p @ w.T
                _adagrad(w, sq, slice(None), h.T @ p, rate)
                continue
            grad = np.empty((len(nodes), DIM + 1, w.shape[2]), np.float32)
            for j, (k, a, b) in enumerate(zip(nodes.tolist(), cut, cut[1:])):
                q = p[a:b]
                np.matmul(h[a:b].T, q, out=grad[j])
                np.matmul(q, w[k].T, out=part[a:b])
            back += part
            _adagrad(w, sq, nodes, grad, rate)
        d = back[:, :DIM] * (1 - h[:, :DIM] ** 2)
        for j, at in enumerate(ctx):
            place = at[order] - j * (self.vocab + 1)
            by = np.argsort(_narrow(place, self.vocab), kind="stable")
            place = place[by]
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            _adagrad(self.emb, g2.emb, place[first] + j * (self.vocab + 1), np.add.reduceat(d.take(by, axis=0).view(np.complex64), first, axis=0).view(np.float32), rate)  # two numbers are added at once


def _adagrad(w: np.ndarray, sq: np.ndarray, at, grad: np.ndarray, rate: float) -> None:
    s = grad * grad
    s += sq[at]
    sq[at] = s
    s += np.float32(1e-10)
    np.sqrt(s, out=s)
    np.divide(grad, s, out=s)
    s *= np.float32(rate)
    w[at] -= s


def _narrow(x: np.ndarray, most: int) -> np.ndarray:
    """Whole numbers up to `most` in 16 bits, which sort by radix, if they fit."""
    return x.astype(np.uint16) if most < 65536 else x


def _exponents(z: np.ndarray) -> np.ndarray:
    """exp(z) in place, and its sum in each row; where a number is large, z less the maximum of its row."""
    if z.size and max(z.max(), -z.min()) > LARGE:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], np.float32)


def _count(batches):
    """Counts of tokens by hash, with their bytes, of a partition in few batches."""
    held, size = [], 0
    for b in batches:
        data, off = flat(pc.utf8_lower(b.column(0)))
        for a, z in chunks(off):
            part = data[off[a] : off[z]]
            t = tokenize(part, off[a : z + 1] - off[a], by_space=False)
            u, at, n = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((u, n, _cut(part, t.starts[at], t.ends[at])))
            size += len(u)
            if size > 1_000_000:
                held = [_sum(held)]
                size = len(held[0][0])
                if size > 500_000:
                    yield _counts(*held.pop())
                    size = 0
    if held:
        yield _counts(*_sum(held))


def _cut(data, starts, ends) -> pa.Array:
    """The tokens' bytes as a binary column."""
    n = ends - starts
    first = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(first[-1]) + np.repeat(starts - first[:-1], n)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(data[at])])


def _sum(held):
    h, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    u, first, at = np.unique(h, return_index=True, return_inverse=True)
    return u, np.bincount(at, n, len(u)).astype(np.int64), pa.concat_arrays([x[2] for x in held]).take(pa.array(first))


def _counts(h, n, token):
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), token], ["h", "n", "token"])


def _beginning(data, starts, ends) -> np.ndarray:
    """Key of the first PREFIX bytes, or of all where there are fewer."""
    n = np.minimum(ends - starts, PREFIX).astype(np.uint64)
    out = n.copy()
    for k in range(PREFIX):
        out = (out << np.uint64(8)) | np.where(n > k, data[np.minimum(starts + k, len(data) - 1)], 0).astype(np.uint64)
    return mix64(out)


def _symbols(data, starts, ends):
    """Bytes of tokens, each with END behind it: first symbol of each token, place within it, the two symbols before, the symbol."""
    n = ends - starts + 1
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    sign = data[np.minimum(np.repeat(starts, n) + place, len(data) - 1)].astype(np.int64)
    sign[first + n - 1] = END
    one = np.concatenate(([END], sign[:-1]))
    one[first] = END
    two = np.concatenate(([END], one[:-1]))
    two[first] = END
    return first, place, two, one, sign


def _pieces(batches):
    """Counts of beginnings (kind 1) and of byte trigrams (kind 0) of tokens, weighted by the tokens' counts."""
    for b in batches:
        token, n = b.column(0).cast(pa.large_binary()), b.column(1).to_numpy()
        off = np.frombuffer(token.buffers()[1], np.int64)[token.offset : token.offset + len(token) + 1]
        if not len(n):
            continue
        data = np.frombuffer(token.buffers()[2], np.uint8)
        _, place, two, one, sign = _symbols(data, off[:-1], off[1:])
        weight = np.repeat(n, off[1:] - off[:-1] + 1)
        for kind, key, m in ((1, _beginning(data, off[:-1], off[1:]).view(np.int64), n), (0, (two << 18) | (one << 9) | sign, weight)):
            u, at = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(np.bincount(at, m, len(u)).astype(np.int64))], ["kind", "key", "n"])


class Vocabulary:
    """Words, beginnings and spelling, as read in a worker."""

    def __init__(self, ranks: pa.Table, spelling: pa.Table):
        kind, h, rank = (ranks.column(c).to_numpy() for c in ("kind", "h", "rank"))
        self.words, self.beginnings = (HashIndex(h[kind == k].view(np.uint64), rank[kind == k].astype(np.int32)) for k in (0, 1))
        key, n = spelling.column("key").to_numpy(), spelling.column("n").to_numpy()
        two, one, sign = key >> 18, (key >> 9) & 511, key & 511
        seen = np.unique(np.append(sign, END))
        size = len(seen) + 1  # the last stands for each sign that no counted token has
        self.sign = np.full(END + 1, size - 1)
        self.sign[seen] = np.arange(len(seen))
        c = np.zeros((size,) * 3, np.float32)
        c[self.sign[two], self.sign[one], self.sign[sign]] = n
        p1 = (c.sum(axis=(0, 1)) + 1) / (c.sum() + size)
        p2 = c.sum(axis=0)
        p2 = (p2 + PRIOR * p1) / (p2.sum(axis=1, keepdims=True) + PRIOR)
        total = c.sum(axis=2, keepdims=True) + PRIOR
        c += PRIOR * p2
        c /= total
        c[:, :, -1] /= max(1, END + 1 - len(seen))
        self.spelling = np.log(c, out=c)

    def ids(self, data, t) -> tuple[np.ndarray, np.ndarray]:
        """Class number of each token; which tokens are no words."""
        ids = self.words.get(t.hash, 0).astype(np.int32)
        rest = np.flatnonzero(ids == 0)
        if len(rest):
            ids[rest] = self.beginnings.get(_beginning(data, t.starts[rest], t.ends[rest]), 0).astype(np.int32)
        return ids, rest

    def spell(self, data, starts, ends, known) -> np.ndarray:
        """Log probability of what follows the beginning, or of the whole token where no beginning is known."""
        if not len(starts):
            return np.zeros(0)
        first, place, two, one, sign = _symbols(data, starts, ends)
        lp = self.spelling[self.sign[two], self.sign[one], self.sign[sign]].astype(np.float64)
        n = ends - starts
        skip = np.where(known, np.where(n < PREFIX, n + 1, PREFIX), 0)
        lp[place < np.repeat(skip, n + 1)] = 0
        return np.add.reduceat(lp, first)


def _vocabulary(paths: tuple[str, str]) -> Vocabulary:
    return keep("pseudo", "vocabulary", paths, lambda: Vocabulary(*map(worker_table, paths)))


def _weights(path: str | None) -> np.ndarray | None:
    """Weights and sums of squares."""
    if path is None:
        return None
    return keep("pseudo", "weights", path, lambda: np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in worker_table(path).sort_by("block").column("w").chunks)]))


def _tokens(col: pa.Array, vocabulary: Vocabulary, spelt: bool = False):
    """For chunks of rows: first row, end row, ids, row numbers and, if asked for, log probabilities of spelling."""
    data, off = flat(pc.utf8_lower(col))
    for a, z in chunks(off):
        part = data[off[a] : off[z]]
        t = tokenize(part, off[a : z + 1] - off[a], by_space=False)
        ids, rest = vocabulary.ids(part, t)
        spelling = np.zeros(len(ids) if spelt else 0)
        for i in range(0, len(rest) if spelt else 0, BATCH):
            at = rest[i : i + BATCH]
            spelling[at] = vocabulary.spell(part, t.starts[at], t.ends[at], ids[at] > 0)
        yield a, z, ids, t.row_of(), spelling


_BLOCK = 4096


def _train(vocab: tuple[str, str], classes: int, weights: str | None, rate: float):
    def run(batches):
        vocabulary = _vocabulary(vocab)
        start = _weights(weights)
        net = Net(None if start is None else start[: len(start) // 2].copy(), classes)
        g2 = Net(np.zeros_like(net.w) if start is None else start[len(start) // 2 :].copy(), classes)
        seen = 0
        for b in batches:
            for _, _, ids, row, _ in _tokens(b.column(0), vocabulary):
                ctx = Net.context(ids, row, net.vocab)
                for i in range(0, len(ids), BATCH):
                    net.step(ids[i : i + BATCH], ctx[:, i : i + BATCH], g2, rate)
                seen += len(ids)
        if seen:
            both = np.concatenate([net.w, g2.w])
            blocks = [both[i : i + _BLOCK] for i in range(0, len(both), _BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([seen] * len(blocks), pa.int64()), pa.array(blocks, pa.list_(pa.float32()))], ["block", "seen", "w"])

    return run


def _average(t):
    seen = t.column("seen").to_numpy().astype(np.float64)
    w = t.column("w").combine_chunks().flatten().to_numpy().reshape(len(seen), -1)
    return pa.table({"block": t.column("block").slice(0, 1), "w": pa.array([(seen @ w / seen.sum()).astype(np.float32)], pa.list_(pa.float32()))})


def classes_for(n_tokens: int) -> int:
    """Classes, and groups a class: the vocabulary, WIDTH times their cube, is as large as the square root of the number of tokens."""
    return max(CLASSES, math.ceil((n_tokens**0.5 / WIDTH) ** (1 / 3) - 1e-9))


def most_frequent(counts: DataFrame, key: str, size: int) -> list[tuple[int, int]]:
    """(key, n) of about the `size` most frequent keys, never more.

    The least count that still fits, and the share of the keys of the next count by a hash, follow from two histograms, so that tasks send no more than the rows that are taken.
    """
    step = F.when(F.col("n") > 1024, F.pow(F.lit(2.0), F.floor(F.log2("n") * 64) / 64) + 0.5).otherwise(F.col("n"))  # 64 steps a doubling
    x = counts.select(key, "n", step.alias("step"), F.pmod(F.xxhash64(key), F.lit(4096)).alias("bucket"))
    by = {r["step"]: r["keys"] for r in x.groupBy("step").agg(F.count("*").alias("keys")).collect()}
    left, least, tied = size, 0.0, None
    for n in sorted(by, reverse=True):
        if by[n] > left:
            tied = n
            break
        left -= by[n]
        least = n
    take = (F.col("step") >= least) if least else F.lit(False)
    if tied is not None and left:
        some, share = {r["bucket"]: r["keys"] for r in x.where(F.col("step") == tied).groupBy("bucket").agg(F.count("*").alias("keys")).collect()}, 0
        while left >= some.get(share, 0):
            left -= some.get(share, 0)
            share += 1
        take = take | ((F.col("step") == tied) & (F.col("bucket") < share))
    return sorted(((r[key], r["n"]) for r in x.where(take).collect()), key=lambda r: (-r[1], r[0]))


def vocabulary(text: DataFrame) -> tuple[tuple[str, str], int, int]:
    """Folders of the words and beginnings with their ranks and of the byte trigrams; the numbers of classes and tokens."""
    spark = text.sparkSession
    counts = stash(text.mapInArrow(_count, "h long, n long, token binary").groupBy("h", "token").agg(F.sum("n").alias("n")), "counts")
    n_tokens = counts.agg(F.sum("n")).first()[0] or 0
    classes = classes_for(n_tokens)
    size = WIDTH * classes**3
    words = [(h, n, 0) for h, n in most_frequent(counts, "h", size * 3 // 4)]
    known = spark.createDataFrame([(h,) for h, _, _ in words], "h long")
    tail = counts.join(F.broadcast(known), "h", "left_anti").select("token", "n")
    pieces = stash(tail.mapInArrow(_pieces, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "pieces")
    begin = [(k, n, 1) for k, n in most_frequent(pieces.where("kind = 1").select("key", "n"), "key", size - 1 - len(words))]
    rows = sorted(words + begin, key=lambda r: (-r[1], r[2], r[0]))  # the vocabulary at most
    ranks, spelling = new_path(spark, "vocabulary"), new_path(spark, "spelling")
    spark.createDataFrame([(h, i + 1, kind) for i, (h, _, kind) in enumerate(rows)], "h long, rank int, kind int").coalesce(1).write.parquet(ranks)
    pieces.where("kind = 0").select("key", "n").coalesce(1).write.parquet(spelling)
    return (ranks, spelling), classes, n_tokens


def train(docs: DataFrame, rounds: int = 1, rate: float = RATE) -> tuple[tuple[str, str], int, str | None]:
    """Folders of the vocabulary, the number of classes and the folder of the weights."""
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    vocab, classes, n_tokens = vocabulary(text)
    lanes = min(LANES, max(1, n_tokens // LANE_TOKENS))
    parts = max(PARTS, math.ceil(math.log2(max(1, n_tokens / lanes / BATCH))))
    dealt = new_path(spark, "dealt")
    h = F.xxhash64("text")
    text.select("text", h.alias("h"), F.pmod(F.xxhash64(h), F.lit(lanes)).cast("int").alias("lane"), F.pmod(h, F.lit(parts)).cast("int").alias("part")).write.partitionBy("part").parquet(dealt)
    text = spark.read.schema("text string, h long, lane int, part int").parquet(dealt)
    weights = None
    for k in range(rounds * parts):
        part = text.where(F.col("part") == k % parts).repartitionById(lanes, F.col("lane")).sortWithinPartitions("h", "text").select("text")
        path = new_path(spark, "weights")
        part.mapInArrow(_train(vocab, classes, weights, rate), "block int, seen long, w array<float>").groupBy("block").applyInArrow(_average, "block int, w array<float>").write.parquet(path)
        if not spark.read.schema("block int, w array<float>").parquet(path).isEmpty():  # else no token in this part
            weights = path
    return vocab, classes, weights


def _score(vocab: tuple[str, str], classes: int, weights: str | None):
    def run(batches):
        vocabulary = _vocabulary(vocab)
        w = _weights(weights)
        net = Net(None if w is None else w[: len(w) // 2], classes)
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for a, z, ids, row, lp in _tokens(b.column(1), vocabulary, spelt=True):
                ctx = Net.context(ids, row, net.vocab)
                for i in range(0, len(ids), BATCH):
                    order, *_, got = net.forward(ids[i : i + BATCH], ctx[:, i : i + BATCH])
                    lp[i + order] += got
                total[a:z] = np.bincount(row, lp, minlength=z - a)
                n[a:z] = np.bincount(row, minlength=z - a)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return run


def score(docs: DataFrame, rounds: int = 1, rate: float = RATE) -> DataFrame:
    vocab, classes, weights = train(docs, rounds, rate)
    use = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return use.mapInArrow(_score(vocab, classes, weights), "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
