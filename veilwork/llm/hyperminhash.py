"""Near-duplicates by HyperMinHash: texts whose sets of five-word shingles have a Jaccard similarity of 85 % at least.

A shingle's hash names one of BUCKETS buckets, and each bucket keeps the least of what is left of its hashes in compressed form, a register
of 16 bits: the number of leading zeros (6 bits) and the MANTISSA bits after the first one. Small sets leave buckets empty; an empty
one takes the register of the first bucket that is not, in an order of its own (the same for all sets), so two registers of any sets agree with
the chance of their similarity, and by collision with less than one in a thousand.

Registers are banded by ROWS: sets that agree in a whole band share a group. At 85 % a band agrees with chance 0.52, so a link
shares none of the 32 bands with chance 6e-11; nearer copies do so less often. Pairs of a group are pruned by the similarity that their
registers estimate, less the collisions expected for sets of their sizes, where it lies eight deviations below 85 %. All that are left are
compared by their whole sets, so nothing is linked that should not be. Groups of any size go the way of `near_copies.connected`:
pairs up to a size, beyond it a star, and members of crowded groups that remain apart meet by what sets them apart from the
group's middle. The work grows with members and links, not with a group's pairs.

Defined results: words are parted by the six ASCII blanks, A-Z in lower case. Texts are read whole, very long ones too. A text of one to four words is one
shingle. Null texts and texts without words have an empty set and are linked with nothing, not even each other. Exact copies are one node
of the graph. Rows with equal ids are documents of their own; a null id counts last when the least id is sought, and a component without any
id has none. Shingles are told apart by 64-bit hashes. An empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm._common import identified, stored, table
from veilwork.llm.near_copies import PAIRED, Ratio, connected, matched, mixed, owners, shingles

LINKED = Ratio(17, 20)
BUCKETS, MANTISSA, ROWS = 128, 10, 4
BANDS = BUCKETS // ROWS
_salt = np.uint64(0x8EBC6AF09C88C6E3)
#: For each bucket the order in which it looks for a register if it is empty: buckets by hash.
_donors = np.argsort(mixed(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64) * _salt).reshape(BUCKETS, BUCKETS), axis=1, kind="stable")


def registers(found: np.ndarray) -> np.ndarray:
    """The registers of a set of shingles' hashes that is not empty."""
    h = np.sort(mixed(found.view(np.uint64) ^ _salt))
    bucket = (h >> np.uint64(64 - 7)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))  # the least of each bucket is its first
    rest = (h[at] << np.uint64(7)) >> np.uint64(11)  # 53 bits, exact in doubles
    zeros = 53 - np.frexp(rest.astype(np.float64))[1]
    mantissa = (rest << (zeros + 12).astype(np.uint64)) >> np.uint64(64 - MANTISSA)  # the first one is pushed out
    own = np.zeros(BUCKETS, np.uint16)
    own[bucket[at]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    if len(at) == BUCKETS:
        return own
    filled = np.zeros(BUCKETS, bool)
    filled[bucket[at]] = True
    empty = np.flatnonzero(~filled)
    order = _donors[empty]
    own[empty] = own[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return own


def bands(own: np.ndarray) -> np.ndarray:
    """A name for each band's registers, told apart by the band."""
    return mixed(own.view(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _salt).view(np.int64)


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers expected to agree by chance for sets of n and m: 0.1699 buckets / 2^mantissa for equal sizes, fewer for others."""
    ratio = n / m
    return 0.169919487159739 * BUCKETS / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of sets of n and m from the number of registers that agree, less collisions."""
    return np.maximum(agree - collisions(n, m), 0) / BUCKETS


def least_estimate(n: np.ndarray, ratio: Ratio) -> np.ndarray:
    """What links of sets of n (the smaller one's size) reach but for eight deviations of the buckets that the set fills."""
    j = ratio.p / ratio.q
    return j - 8 * np.sqrt(j * (1 - j) / (BUCKETS * -np.expm1(-n / BUCKETS)))


def sketches(rows: DataFrame, text: str = "text") -> DataFrame:
    """who, node, n (shingles), sketch (registers) and bands for each row; the last two are null for a node that the task has had before and for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                nodes, sizes, kept, keys = [], [], [], []
                for value in part.column(1):
                    node, found = shingles(value.as_py() or "")
                    nodes.append(node)
                    sizes.append(len(found))
                    if node in had or not len(found):
                        kept.append(None)
                        keys.append(None)
                        continue
                    had.add(node)
                    own = registers(found)
                    kept.append(own.tobytes())
                    keys.append(bands(own))
                columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["who", "node", "n", "sketch", "bands"])

    return rows.select("who", f"`{text}`").mapInArrow(run, f"who {rows.schema['who'].dataType.simpleString()}, node long, n long, sketch binary, bands array<long>")


def likely(pairs: DataFrame, held: DataFrame, ratio: Ratio) -> DataFrame:
    """Those of the pairs (a, b) whose sketches in held(node, n, sketch) leave it possible that they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(np.float64) for k in (2, 4))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (3, 5))
            good = estimate((x == y).sum(1), n, m) >= least_estimate(np.minimum(n, m), ratio)
            yield batch.select([0, 1]).filter(pa.array(good))

    side = lambda at: held.select(F.col("node").alias(at), F.col("n").alias(f"n_{at}"), F.col("sketch").alias(f"s_{at}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: Ratio = LINKED) -> DataFrame:
    """key, n_shingles, component_id (the least key reachable) for each row."""
    rows = identified(docs, key)
    found = stored(sketches(rows, text), "sketches")
    owned = owners(found.filter("n > 0").select("who", "node"))
    held = found.filter("sketch is not null").select("node", "n", "sketch").dropDuplicates(["node"])
    entries = found.filter("bands is not null").select("node", "n", F.lit(0).alias("at"), F.explode("bands").alias("s"))
    sizes = entries.groupBy("s").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("size")).filter("least <> most").select("s", "least", "size")
    members = stored(entries.join(sizes, "s").distinct(), "members")
    roots = connected(members, lambda pairs: likely(pairs, held, ratio), rows, owned, text, ratio, merged=True, crowded=PAIRED)

    ids = owned.select("node", F.col("who.id").alias("id"))
    linked = stored(roots.join(ids, "node"), "linked")
    of_root = linked.groupBy("root").agg(F.min("id").alias("least"))
    of_node = stored(matched(linked.select("root", "node"), of_root, "root").select("node", "least").union(ids.join(linked, "node", "left_anti").select("node", "id")), "least")
    whole = found.filter("n > 0").select("node", F.col("who.id").alias("id"), "n")
    out = matched(whole, of_node, "node").select("id", "n", "least").union(found.filter("n = 0").select(F.col("who.id").alias("id"), "n", F.col("who.id").alias("least")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.expr("doc_id <=> component_id"))


#: Pairs are made of distinct sets that share a shingle, as SQL states it best; the operator makes none of these.
SQL = r"""
with recursive docs as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) end as v from docs),
nodes as materialized (select min(r) as node, v, len(v) as n from sets where len(v) > 0 group by v),
said as materialized (select node, n, unnest(v) as s from nodes),
pairs as materialized (
  select a.node as a, b.node as b from said a join said b on a.s = b.s and a.node < b.node and 20 * least(a.n, b.n) >= 17 * greatest(a.n, b.n)
  group by a.node, b.node, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways as (select a, b from pairs union all select b, a from pairs),
reach(node, other) as (select node, node from nodes union select reach.node, ways.b from reach join ways on reach.other = ways.a),
least as (select reach.node, min(sets.doc_id) as component_id from reach join nodes on nodes.node = reach.other join sets on sets.v = nodes.v group by reach.node),
of_doc as (select doc_id, len(v) as n_shingles, case when len(v) = 0 then doc_id else component_id end as component_id from sets left join nodes using (v) left join least using (node))
select doc_id, n_shingles, component_id, doc_id is not distinct from component_id as kept from of_doc
"""
