"""Near-duplicates by SimHash fingerprints that differ in few bits.

Candidates are pruned by the pigeonring principle. The 64 bits form a ring of three segments; if two fingerprints differ in at
most 2 bits, then some segment begins a chain whose first segment has no difference (2/3 of a bit is its share), whose first two
have at most one, and whose three have at most two. So fingerprints are grouped by one segment and, since the next one may hold
at most one difference, by either half of that one: six groups of 31 bits or more for each fingerprint. Pairs within a group whose chain
keeps its budgets reach the full Hamming check.

Exact copies share a fingerprint, and only distinct fingerprints are grouped. A group may still be large, as of thousands of near
copies. Pairs are made in groups of at most PAIRED; in a larger one each member meets the others at the fingerprints one bit
away from it (in the bits that the group leaves open): two members share such a point, or one is the other's, if and only if they
differ in at most 2 bits. So the work grows with the members, not with their pairs, and no link is lost.

Defined results: a null text has no words and fingerprint zero, like any text without words; such documents are linked like any
other. Rows with equal ids are documents of their own; a null id counts last when the least id is sought, and a component
without any id has none. An empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm._common import cut, identified, table
from veilwork.llm.components import components

SEED = 42
BITS = 2
PAIRED = 32
#: (first bit, number of bits) of the ring's segments, and of the halves of each.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def lower_words(text: str) -> list[bytes]:
    """Words in UTF-8, A-Z in lower case. Of bytes, lower() changes these alone and split() parts at the six ASCII blanks alone."""
    return text.encode().lower().split()


def fingerprint(text: str, size: int = 3) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; 0 without words."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """key and f (the fingerprint as a signed long) for each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(v.as_py() or "", size) for v in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [key, "f"])

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, f long")


def _mask(first: int, n: int) -> int:
    value = ((1 << n) - 1) << first
    return value - (1 << 64) if value >= 1 << 63 else value


def _distance(a: Column, b: Column, mask: int = -1) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask)))


def _groups() -> list[tuple[int, int]]:
    """For each of the six kinds of group: the mask of its bits, and the segment that its chains begin with."""
    out = []
    for i in range(3):
        first, n = SEGMENTS[(i + 1) % 3]
        half = n // 2
        for at, k in ((first, half), (first + half, n - half)):
            out.append((_mask(*SEGMENTS[i]) | _mask(at, k), i))
    return out


def chained(apart: list[Column], bits: int) -> Column:
    """Whether some chain of consecutive segments of the ring, given how far apart two fingerprints are in each, keeps within its share of bits at each length.

    The longest chain is the whole ring, so what passes differs in at most `bits` bits.
    """
    m = len(apart)

    def chain(i: int) -> Column:
        sums = [sum(apart[(i + k) % m] for k in range(n)) for n in range(1, m + 1)]
        return reduce(lambda a, b: a & b, [s * m <= bits * n for n, s in enumerate(sums, 1)])

    return reduce(lambda a, b: a | b, [chain(i) for i in range(m)])


def links(distinct: DataFrame) -> DataFrame:
    """distinct(f) -> (a, b): links that connect exactly the fingerprints that chains of links of at most BITS bits connect."""
    groups = _groups()
    member = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col("f").bitwiseAND(F.lit(mask)).alias("bits")) for g, (mask, _) in enumerate(groups)]))
    members = distinct.select("f", member.alias("k")).select("k.g", "k.bits", "f")
    sizes = members.groupBy("g", "bits").count().filter("count > 1")
    members = cut(members.join(sizes, ["g", "bits"]))

    small = members.filter(F.col("count") <= PAIRED)
    left, right = small.select("g", "bits", F.col("f").alias("a")), small.select("g", "bits", F.col("f").alias("b"))
    # A chain of three segments; the first is equal since its bits belong to the group.
    chain = [F.lit(_mask(*SEGMENTS[(i + 1) % 3])) for _, i in groups]
    second = F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.element_at(F.array(*chain), F.col("g") + 1)))
    pairs = left.join(right, ["g", "bits"]).filter("a < b").filter(second <= BITS * 2 // 3).filter(_distance(F.col("a"), F.col("b")) <= BITS).select("a", "b")

    open_bits = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_mask(i, 1)) for i in range(64) if not mask >> i & 1]) for mask, _ in groups])
    points = members.filter(F.col("count") > PAIRED).select("g", "f", F.explode(F.element_at(open_bits, F.col("g") + 1)).alias("flip"))
    points = points.select("g", F.col("f").bitwiseXOR(F.col("flip")).alias("point"), "f")
    met = points.groupBy("g", "point").agg(F.min("f").alias("a"), F.max("f").alias("most")).filter("a <> most").select("g", "point", "a")
    stars = points.join(met, ["g", "point"]).filter("a <> f").select("a", F.col("f").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """key, f, component_id (the least key reachable) for each row."""
    prints = cut(fingerprints(docs, key, text, size))
    distinct = cut(prints.groupBy("f").agg(F.min(key).alias("least")))
    roots = cut(components(links(distinct.select("f"))))
    # Fingerprints without a link are roots of their own; those alone with one document need no join for it, but are few bytes.
    rooted = distinct.join(roots.withColumnRenamed("node", "f"), "f", "left").select("f", F.coalesce("root", "f").alias("root"), "least")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(of_root, "root").select("f", "component_id")
    return prints.join(of_print, "f").select(key, "f", "component_id")


def only(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """Of the rows of identified(docs) those that keep(who) names, each once, without who."""
    keep = cut(keep.groupBy("who").count())
    doc = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "who"]).alias("doc")
    out = rows.select(doc, "who").join(keep.select("who"), "who", "left_semi")
    if keep.filter("count > 1").head(1):  # rows wholly alike; partial aggregates leave one a task, so any number of them may be
        again = keep.filter("count > 1").select("who")
        out = out.join(again, "who", "left_anti").select("doc").union(out.join(again, "who", "left_semi").groupBy("who").agg(F.first("doc").alias("doc")).select("doc"))
    return out.select("doc.*")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """One row of docs for each component: that of the least id, nulls last; of several rows with that id, the one of the least digest."""
    rows = identified(docs, key)
    found = near_duplicates(rows, "who", text, size)
    return only(rows, found.filter(F.col("who") == F.col("component_id")).select("who"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
