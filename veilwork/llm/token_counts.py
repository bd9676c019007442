"""Token counts without ids: pieces are counted once per distinct pre-token, joined to per-document frequencies and summed.

A pre-token is a run of word marks with what follows up to the next one, or a line feed: no piece of the model reaches over such
a bound, so the counts of a text's pre-tokens add up to the text's.

The join has two ways. The pre-tokens that most tasks have met (two at least: what only one has met is not worth sending to all),
up to HEAD of them, are broadcast as 64-bit hashes with counts (9 bytes each, so at most 36 MB); pre-tokens of the corpus that share a hash are left out of it, so a hash found there is exact.
All others are joined by a shuffle on the pre-token; these are rare ones, so no key is hot.

Defined results: a null text is an empty one with no token. Texts are read whole. Repeated rows each get their own result, an
empty table gives an empty one, and other columns are left aside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm._common import stored, table

HEAD = 4_000_000
#: Distinct pre-tokens that a task holds before it passes them on; also those whose counts a worker keeps at hand.
HELD = 400_000
MARK = "▁"
PRE_TOKEN = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def pre_tokens(text: str) -> list[str]:
    """Of a text as the model's normaliser leaves it: blanks are marks, and one mark is put before a text that is not empty."""
    return PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def model_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def piece_counter(model: bytes):
    """A function from pre-tokens to their numbers of pieces, by the library. The pre-tokens already hold the leading mark."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.normalizer_spec.add_dummy_prefix = False
    processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    return lambda tokens: [len(ids) for ids in processor.encode(tokens, num_threads=1)]


def hashed(tokens) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in tokens), np.uint64).view(np.int64)


def distinct_counts(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """token, hash, spread (the number of tasks that met it) and n (its pieces), one row per distinct pre-token."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        for batch in batches:
            for value in batch.column(0):
                held.update(pre_tokens(value.as_py() or ""))
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["token"])
                    held = set()
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["token"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_counter(shared.value)
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            arrays = [batch.column(0), pa.array(hashed(tokens)), batch.column(1), pa.array(pieces(tokens), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["token", "hash", "spread", "n"])

    tokens = docs.select(f"`{text}`").mapInArrow(met, "token string").groupBy("token").agg(F.count("*").alias("spread"))
    return tokens.mapInArrow(count, "token string, hash long, spread long, n long")


def head_of(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sorted hashes and counts of the widest spread pre-tokens, at most so many, and whether these are all."""
    by_spread = sorted(counted.groupBy("spread").count().collect(), reverse=True)  # at most a row for each task
    least, held, total = None, 0, sum(n for _, n in by_spread)
    for spread, n in by_spread:
        if spread < 2 or held + n > most:
            break
        least, held = spread, held + n
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.uint8), not total
    clash = F.count("*") > 1
    clashing = [r[0] for r in counted.groupBy("hash").agg(clash.alias("c")).filter("c").select("hash").collect()] if total > 1 else []
    got = counted.filter(F.col("spread") >= least).select("hash", F.col("n")).toArrow()
    hashes, counts = got.column(0).to_numpy(), got.column(1).to_numpy()
    good = ~np.isin(hashes, np.array(clashing, np.int64)) & (counts < 256)
    hashes, counts = hashes[good], counts[good].astype(np.uint8)
    order = np.argsort(hashes)
    return hashes[order], counts[order], len(hashes) == total


class Sums:
    """Per-document sums over the head, and the pre-tokens beyond it."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes, self.counts = hashes, counts
        self.known: dict[str, int] = {}

    def learn(self, tokens: list[str]) -> None:
        """The numbers of pieces of these; -1 for those beyond the head."""
        h = hashed(tokens)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        n = np.where(self.hashes[at] == h, self.counts[at].astype(np.int64), -1) if len(self.hashes) else np.full(len(h), -1)
        self.known.update(zip(tokens, n.tolist(), strict=True))

    def of(self, text: str) -> tuple[int, dict[str, int]]:
        if len(self.known) >= HELD:
            self.known.clear()
        known, freq = self.known, Counter(pre_tokens(text))
        if new := [t for t in freq if t not in known]:
            self.learn(new)
        total, rest = 0, {}
        for token, times in freq.items():
            if (k := known[token]) < 0:
                rest[token] = times
            else:
                total += k * times
        return total, rest


def token_counts(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", limit: int = 4096, most: int = HEAD) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit for each row."""
    spark = docs.sparkSession
    counted = stored(distinct_counts(docs, model, text), "pre-tokens")
    hashes, counts, whole = head_of(counted, most)
    shared = spark.sparkContext.broadcast((hashes, counts))
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n_bytes", "text_id", "token", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(*shared.value)
        for batch in batches:
            texts = [v or "" for v in batch.column(1).to_pylist()]
            at, size, ids, token, n = [], [], [], [], []
            for i, (total, rest) in enumerate(map(sums.of, texts)):
                raw = texts[i].encode()
                text_id = None if whole else xxhash.xxh3_128_digest(raw)
                for t, k in ((None, total), *rest.items()):
                    at.append(i)
                    size.append(len(raw))
                    ids.append(text_id)
                    token.append(t)
                    n.append(k)
            keys = batch.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(token, pa.string()), pa.array(n, pa.int64())], names)

    rows = docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"key {kind}, n_bytes long, text_id binary, token string, n long")
    if whole:  # every pre-token is in the head
        rows = rows.select("key", "n_bytes", F.col("n").alias("n_tokens"))
    else:
        rows = stored(rows, "frequencies")
        head = rows.filter("token is null").select("key", "n_bytes", "text_id", "n", F.lit(1).alias("rows"))
        tail = rows.filter("token is not null").withColumnRenamed("n", "times").join(counted.select("token", "n"), "token")
        tail = tail.select("key", "n_bytes", "text_id", (F.col("n") * F.col("times")).alias("n"), F.lit(0).alias("rows"))
        both = head.unionByName(tail).groupBy("key", "n_bytes", "text_id").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
        # Rows that are alike in key and text have been added up together.
        each = F.explode(F.array_repeat((F.col("n") / F.col("rows")).cast("long"), F.col("rows").cast("int")))
        rows = both.select("key", "n_bytes", each.alias("n_tokens"))
    return rows.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), model_bytes())
