"""Importance resampling towards a target: hashed features of words, counted and scored by tries local to a partition.

A task walks a trie of words: a path of n words is a feature, and its node holds how often it was met and the CRC state of its words
joined by spaces, so a feature's CRC grows from its parent's by one word. Counting tries end as totals of buckets (`counted`); these
are summed over tasks, the raw corpus and the target apart, and a bucket's gain is the logarithm of how much more likely the target has it.
Scoring tries hold the gain in place of the count, so a document's weight is a sum along its paths. A trie that holds NODES nodes is
emptied, so a task's memory is bounded whatever the texts. Only the buckets' totals (a number given) come to the driver, and their gains are
sent about. Documents are drawn without replacement by adding Gumbel noise to the weights and taking the highest scores; the noise is
that of the id, so reruns agree. Scores are ranked by ranges: no task holds all of them.

Defined results: a null text has no words, and so has a text of separators. Texts are read whole, very long ones too. Rows with equal
ids have the same noise and are drawn each for itself; equal scores go by id, null ids (hashed as empty) last, then by features. Without any
target, gains are those of counts of zero. An empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm._common import stored, table
from veilwork.operators.ranking import ranked

#: Nodes of a trie; some 60 MB.
NODES = 200_000
#: Letters in lower case and digits stay, as do bytes of other characters; all else parts words.
_table = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_table).split()


class Trie:
    """Nodes are [value, crc, children]; children are there once a node has one."""

    def __init__(self, size: int, buckets: int, gains: np.ndarray | None = None, nodes: int = NODES) -> None:
        self.size, self.buckets, self.nodes = size, buckets, nodes
        self.gains = None if gains is None else gains.tolist()
        self.totals = np.zeros(buckets, np.int64)
        self.root, self.held = [0, 0, {}], 0

    def _grown(self, parent: list, word: bytes) -> list:
        crc = crc32(word, crc32(b" ", parent[1])) if parent is not self.root else crc32(word)
        child = [self.gains[crc % self.buckets] if self.gains else 0, crc, None]
        if parent[2] is None:
            parent[2] = {}
        parent[2][word] = child
        self.held += 1
        return child

    def _child(self, node: list, word: bytes) -> list:
        return (node[2] and node[2].get(word)) or self._grown(node, word)

    def count(self, words: list[bytes]) -> None:
        """Each feature of the words counts once more."""
        for at in range(len(words)):
            node = self.root
            for word in words[at : at + self.size]:
                node = self._child(node, word)
                node[0] += 1
            if self.held >= self.nodes:
                self.flush()

    def flush(self) -> None:
        """Counts go to the totals of their buckets; the trie is empty."""
        rest = [self.root]
        while rest:
            for child in (rest.pop()[2] or {}).values():
                self.totals[child[1] % self.buckets] += child[0]
                rest.append(child)
        self.root, self.held = [0, 0, {}], 0

    def weigh(self, words: list[bytes]) -> tuple[int, int]:
        """The number of features, and the sum of their gains."""
        n = total = 0
        for at in range(len(words)):
            node = self.root
            for word in words[at : at + self.size]:
                node = self._child(node, word)
                n += 1
                total += node[0]
            if self.held >= self.nodes:
                self.root, self.held = [0, 0, {}], 0
        return n, total


def counted(docs: DataFrame, text: str = "text", size: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket and n for each bucket that features of the texts fall in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(size, buckets)
        for batch in batches:
            for value in batch.column(0):
                trie.count(words_of(value.as_py()))
        trie.flush()
        met = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(trie.totals[met])], ["bucket", "n"])

    return docs.select(f"`{text}`").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """A bucket's gain, in thousandths of a natural logarithm; a row for each bucket comes to the driver."""
    totals = np.zeros((2, buckets), np.int64)
    for side, bucket, n in raw.withColumn("side", F.lit(0)).union(target.withColumn("side", F.lit(1))).select("side", "bucket", "n").collect():
        totals[side, bucket] = n
    whole = [float(int(t.sum()) + buckets) for t in totals]
    return np.array([math.floor(1000 * math.log(float(t + 1) * whole[0] / (float(s + 1) * whole[1]))) for s, t in totals.T.tolist()], np.int64)


def noise(seed: int, key: object) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", size: int = 1, seed: int = 2024) -> DataFrame:
    """key, n_words, n_features, weight and score for each row."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(size, len(sent.value), sent.value)
        for batch in batches:
            rows = []
            for id_, value in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(value.as_py())
                n, weight = trie.weigh(words)
                rows.append((len(words), n, weight, weight + noise(seed, id_.as_py())))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "n_words", "n_features", "weight", "score"])

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", size: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """key, n_words, n_features, weight, score and rank for each row; rank is null for those not drawn."""
    gain = gains(counted(docs, text, size, buckets), counted(target, target_text, size, buckets), buckets)
    rows = stored(scored(docs, gain, key, text, size, seed).withColumnRenamed(key, "id"), "scores")
    able = rows.filter(F.col("n_words") >= least_words).select("*", (-F.col("score")).alias("by_score"), F.col("id").isNull().alias("by_none"))
    drawn = able.count() * percent // 100
    order = ["by_score", "by_none", "id", "n_features", "weight"]
    placed = ranked(able, [], order).select(*rows.columns, F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long").alias("rank"))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.union(rest).withColumnRenamed("id", key)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its reflected polynomial, a byte at a time over a table made by the rule; once for each distinct word.
SQL = r"""
with docs as materialized (select row_number() over () as r, doc_id, text from documents),
steps as materialized (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
said as materialized (
  select 0 as side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from docs
  union all
  select 1, null, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
hashed as materialized (
  select w, xor(list_reduce(list_transform(range(strlen(w)), lambda i: cast('0x' || substr(hex(w), cast(2 * i + 1 as bigint), 2) as bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket
  from (select distinct w from said), steps),
totals as (select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from said join hashed using (w) group by bucket),
gains as (
  select bucket, cast(floor(1000 * ln(cast(t + 1 as double) * ((select sum(s) from totals) + 10000)::double
    / (cast(s + 1 as double) * ((select sum(t) from totals) + 10000)::double))) as bigint) as gain from totals),
weights as (select r, count(*) as n, sum(gain) as weight from said join hashed using (w) join gains using (bucket) where side = 0 group by r),
scores as materialized (
  select doc_id, coalesce(n, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight, cast(coalesce(weight, 0) as bigint)
    + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from docs left join weights using (r)),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features, weight) as place, (select count(*) from scores where n_features >= 20) as able from scores)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= able * 10 // 100 then place end as rank from placed
"""
