"""Quality scores by random-indexing word vectors pooled per document and a two-layer numpy network.

Tokens (runs of letters and digits, or of other marks) fall into TABLE buckets by hash; words that share one share a vector, which is
the price of a table of fixed size. Each bucket has a fixed sparse index vector; its
context vector is the sum of the index vectors of its neighbours within two places, over the whole corpus. These sums are whole
numbers, so their order does not matter; a task adds up its own and passes on one row per bucket, and Spark adds up the rows.
A document is the mean of its tokens' context vectors (of unit length), and the length of that mean.

The network is fitted on at most SAMPLE labelled documents (those whose id's hash is least) outside the held-out quarter; a fifth
of them is kept apart to fit the temperature that calibrates its scores. Labels, language, source and id are no inputs.

Defined results: a null or empty text has the zero vector and gets the network's score of that. Rows alike get the same score;
a null id is not held out. Unless both labels occur every score is 0.5; few labelled rows are fitted like many. Of repeated ids each row is fitted with each
label that its id has. Other columns are left aside. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm._common import cut, table

TABLE, DIM, NONZERO = 1 << 14, 32, 2
SAMPLE = 20_000
HELD = 300_000
HIDDEN = 32
INPUTS = DIM + 1
_token = re.compile(r"\w+|[^\w\s]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places of its nonzero entries and their signs."""
    g = np.random.default_rng(17)
    return g.integers(0, DIM, (TABLE, NONZERO)), g.choice([-1.0, 1.0], (TABLE, NONZERO))


class Buckets(dict):
    """Bucket of each token; the latest HELD tokens are remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) >= HELD:
            self.clear()
        n = zlib.crc32(token.encode()) % TABLE
        if len(token) <= 64:
            self[token] = n
        return n

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, _token.findall(text)), np.int64)


def texts_of(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def context_sums(ids: np.ndarray, into: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> None:
    """Add to `into` (flat) the index vectors of each id's neighbours; -1 parts documents."""
    places, signs = index
    for far in (1, 2):
        a, b = ids[:-far], ids[far:]
        good = (a >= 0) & (b >= 0)
        if far == 2:
            good &= ids[1:-1] >= 0
        a, b = a[good], b[good]
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                into += np.bincount(x * DIM + places[y, j], signs[y, j], TABLE * DIM).astype(np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """TABLE context vectors of unit length (zero for buckets without neighbours), from all of docs."""
    names = [f"c{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, index, sums = Buckets(), index_vectors(), np.zeros(TABLE * DIM, np.int64)
        held, n = [], 0
        gap = np.array([-1])
        for batch in batches:
            for t in texts_of(batch.column(0)):
                held += [buckets.of(t), gap]
                n += len(held[-2]) + 1
                if n >= 500_000:
                    context_sums(np.concatenate(held), sums, index)
                    held, n = [], 0
        if held:
            context_sums(np.concatenate(held), sums, index)
        rows = sums.reshape(TABLE, DIM)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(rows[used, i]) for i in range(DIM))], ["bucket", *names])

    parts = docs.select(f"`{text}`").mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in names))
    got = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # TABLE rows at most
    out = np.zeros((TABLE, DIM))
    if got.num_rows:
        out[got.column(0).to_numpy()] = np.stack([got.column(i + 1).to_numpy() for i in range(DIM)], 1)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def pooled(texts: Iterator[str], vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """The mean vector of each text, and its length, which tells one word said over and over from many words."""
    out = []
    for t in texts:
        n = len(ids := buckets.of(t))
        total = np.zeros(DIM)
        for at in range(0, n, 1 << 18):
            total += vectors[ids[at : at + (1 << 18)]].sum(0, dtype=np.float64)
        total /= max(1, n)
        out.append(np.append(total, np.sqrt(total @ total)))
    return np.array(out).reshape(-1, INPUTS)


class Network:
    def __init__(self) -> None:
        self.mean, self.scale, self.temperature = np.zeros(INPUTS), np.ones(INPUTS), 1.0
        self.u, self.b, self.v, self.c = np.zeros((INPUTS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.u + self.b) @ self.v + self.c

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """Adam on the logistic loss, both labels weighed alike in the fit; the temperature is fitted on a fifth kept apart."""
    net = Network()
    if not len(y) or y.min() == y.max():
        return net
    g = np.random.default_rng(3)
    order = g.permutation(len(y))
    kept, rows = order[: len(y) // 5], order[len(y) // 5 :]
    if y[rows].min() == y[rows].max():  # so few that a label would be missing
        rows = order
    net.mean, net.scale = x[rows].mean(0), x[rows].std(0) + 1e-6
    z = (x - net.mean) / net.scale
    p = [g.normal(0, INPUTS**-0.5, (INPUTS, HIDDEN)), np.zeros(HIDDEN), g.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    weight = np.where(y == 1, 0.5 / max(1e-9, (y[rows] == 1).mean()), 0.5 / max(1e-9, (y[rows] == 0).mean()))
    m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        rows = g.permutation(rows)
        for at in range(0, len(rows), 128):
            i = rows[at : at + 128]
            h = np.tanh(z[i] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) * weight[i] / len(i)
            d = e[:, None] * p[2] * (1 - h * h)
            grads = [z[i].T @ d + decay * p[0], d.sum(0), h.T @ e + decay * p[2], e.sum(keepdims=True)]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad * grad
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    net.u, net.b, net.v, net.c = p[0], p[1], p[2], float(p[3][0])
    raw, labels = net.logits(x[kept]), y[kept]
    loss = lambda temperature: np.logaddexp(0, np.where(labels == 1, -raw, raw) / temperature).mean()
    if len(kept):
        net.temperature = min(np.geomspace(0.1, 20, 120), key=loss)
    return net


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, accept: float = 0.7) -> DataFrame:
    """key, held_out, score and predicted for each row of docs."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text))
    chosen = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("double").alias("y")).filter("k is not null and y is not null")
    chosen = cut(chosen.filter(~held_out(F.col("k"))).orderBy(F.xxhash64("k"), "k", "y").limit(sample))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            x = pooled(texts_of(batch.column(2)), vectors.value, buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x[:, i]) for i in range(INPUTS))], ["h", "y", *(f"x{i}" for i in range(INPUTS))])

    found = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen), "k")  # at most `sample` rows are sent
    found = found.select(F.xxhash64("k", "t").alias("h"), "y", "t").mapInArrow(features, "h long, y double, " + ", ".join(f"x{i} double" for i in range(INPUTS)))
    rows = found.orderBy("h", "y").limit(sample).toArrow()
    x = np.stack([rows.column(i + 2).to_numpy() for i in range(INPUTS)], 1)
    net = spark.sparkContext.broadcast(fitted(x, rows.column(1).to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            q = net.value.scores(pooled(texts_of(batch.column(2)), vectors.value, buckets))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q), pa.array((q >= accept).astype(np.int32))], [key, "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(f"`{key}`", held_out(F.col(f"`{key}`")).alias("held_out"), f"`{text}`").mapInArrow(score, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
