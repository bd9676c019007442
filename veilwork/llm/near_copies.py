"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 4/5 at least, found whole.

SimHash fingerprints are what candidates are checked by, but they cannot name all of them: at a similarity of 4/5 fingerprints of 64
bits differ in some 10 bits, and often in 17, so groups that hold every such pair would share too few bits to tell texts apart.
Candidates come from an exact join by prefixes instead. All shingles have one order; if two sets of n and m shingles are that
similar, they share one among the first n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1 of them. Texts are grouped by each shingle of
their prefix, and pairs whose sizes and places cannot reach 4/5 are left out: the first shingle that two sets share leaves at most
the rest of the shorter one. Any order gives the same pairs: shingles that a sample finds common come last, which keeps groups
small, and the others go by their hashes.

Candidates are then pruned by the pigeonring principle over wide SimHash fingerprints, a ring of WIDE segments of 64 bits: some chain
of consecutive segments must keep within its share of WIDE_BITS at each length. Pairs at 4/5 differ in 16 % of the bits at most
(sets of SMALL shingles and more; smaller ones are not pruned), 41 of 256 with a deviation of 6, so a pair beyond 88 is at 4/5 with
a chance below 1e-14, less than that of equal hashes. The pairs left are compared by their whole sets.

Exact copies are one node. In a group of more than PAIRED nodes all are first compared with the least one. Where some stay
apart, pairs are made of those not yet connected in groups of up to CROWDED nodes, so each has no more partners. In larger ones
each member's set is told by what sets it apart from the group's middle, the shingles that more than half of the members have. The sets
of d and e shingles apart, of texts of n and m, differ from one another in d + e at most, so they are linked if 9 (d + e) <= n + m; all
pairs of this kind are connected by links with the member nearest to the middle. Any other link needs shared ones among what sets the
two apart, 2 of them for each that d + e is beyond (n + m) / 9, so it is found by an exact join by prefixes once more: the group's
rarest come first, what few of the members have or lack. Copies with changes of their own thus meet where they share a change, not
in pairs. No link is lost, whatever the middle and the order, but for the chance of 1e-14 that the fingerprints' prune has.

Defined results: words are those of the fingerprints (ASCII letters in lower case), a text of fewer than five is one shingle.
Null texts and texts without words are copies of each other. Shingles and word sequences are told apart by 64-bit hashes. Rows with
equal or null ids are told apart by a digest of the whole row, rows wholly alike are copies. An empty table gives an empty one;
other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm._common import cut, identified, stored
from veilwork.llm.components import components
from veilwork.llm.simhash import chained, lower_words

SIZE = 5
PAIRED, CROWDED = 32, 256
WIDE, WIDE_BITS, SMALL = 4, 88, 17
#: Common shingles are those met in SEEN texts of a sample of one text in SAMPLED; the most frequent COMMON of them are broadcast.
SAMPLED, SEEN, COMMON = 32, 3, 100_000
#: In large groups shingles met in SEEN members count; the most frequent KNOWN of all groups are broadcast, other ones count as rare.
KNOWN = 1_000_000
#: Members, about, that tell the middle of a group that has been merged from others. Links are the same whatever the middle is.
TOLD = 256
#: The share of a table's rows beyond which a key is heavy; at most so many keys are.
HEAVY = 1000
#: Rows named by a list of up to so many bytes are found by sending the list about, by a shuffle join beyond.
BROADCAST_BYTES = 32 << 20
_odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_fields = ", ".join(f"f{i} long" for i in range(WIDE))


@dataclass(frozen=True)
class Ratio:
    """The least Jaccard similarity of a link, p / q. Two sets of n and m are linked if they share at least (n + m) p / (p + q)."""

    p: int
    q: int

    @property
    def both(self) -> int:
        return self.p + self.q

    @property
    def apart(self) -> int:
        return self.q - self.p


FOUR_FIFTHS = Ratio(4, 5)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number spread over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """The hash of each word; the latest are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        n = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        if len(word) <= 64:
            self[word] = n
        return n


_words = Words()


def shingles(text: str) -> tuple[int, np.ndarray]:
    """A hash of the words, and the distinct shingles' hashes; both signed. A shingle's hash mixes those of its words by place."""
    words = lower_words(text)
    node = int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).astype(np.int64))
    if not words:
        return node, np.zeros(0, np.int64)
    each = np.fromiter(map(_words.__getitem__, words), np.int64, len(words)).view(np.uint64)
    k = min(SIZE, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = mixed(total + each[i : i + n] * _odd[i])
    found = np.sort(total.view(np.int64))
    return node, found[np.concatenate(([True], found[1:] != found[:-1]))]


def wide(found: np.ndarray) -> list[int]:
    """SimHash over WIDE times 64 bits of a set of shingles: a bit is 1 if more than half of the shingles' hashes have it."""
    lanes, starts = np.uint64(0x0101010101010101), np.arange(0, len(found), 255)
    h = mixed(found.view(np.uint64)[None] + _odd[:WIDE, None])
    ones = np.zeros((WIDE, 8, 8), np.int64)  # segment, byte, bit
    for bit in range(8 if len(found) else 0):  # eight counts of up to 255 are added at once, one in each byte
        sums = np.add.reduceat((h >> np.uint64(bit)) & lanes, starts, axis=1)
        ones[:, :, bit] = sums.view(np.uint8).reshape(WIDE, -1, 8).sum(1, dtype=np.int64)
    return np.packbits((ones * 2 > len(found)).reshape(WIDE, 64), axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def _prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def _sets(docs: DataFrame, text: str) -> DataFrame:
    """node and shingles for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(v.as_py() or "") for v in batch.column(0)[at : at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), _lists([s for _, s in found])], ["node", "shingles"])

    return docs.select(f"`{text}`").mapInArrow(run, "node long, shingles array<long>")


def common(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met often in a sample, sorted, and how often."""
    sample = _sets(docs.filter(F.pmod(F.xxhash64(f"`{text}`"), F.lit(SAMPLED)) == 0).select(f"`{text}`").distinct(), text)
    met = sample.select(F.explode("shingles").alias("s")).groupBy("s").count().filter(F.col("count") >= SEEN)
    top = sorted((r[0], r[1]) for r in met.orderBy(F.desc("count"), "s").limit(COMMON).collect())
    return np.array([s for s, _ in top], np.int64), np.array([c for _, c in top], np.int64)


def prefixes(rows: DataFrame, text: str) -> DataFrame:
    """who, node, n (shingles), prefix (in order) and the wide fingerprint for each row; the last two are empty for a node that the task has had before."""
    shared = rows.sparkSession.sparkContext.broadcast(common(rows, text))
    names = ["who", "node", "n", "prefix", *(f"f{i}" for i in range(WIDE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = shared.value
        had = set()
        for batch in batches:
            nodes, sizes, firsts, prints = [], [], [], []
            for v in batch.column(1):
                node, found = shingles(v.as_py() or "")
                nodes.append(node)
                sizes.append(len(found))
                if node in had or not len(found):
                    firsts.append(found[:0])
                    prints.append([None] * WIDE)
                    continue
                had.add(node)
                prints.append(wide(found))
                if len(often):
                    at = np.minimum(np.searchsorted(often, found), len(often) - 1)
                    found = found[np.argsort(np.where(often[at] == found, counts[at], 0), kind="stable")]
                firsts.append(found[: _prefix(len(found))])
            columns = [pa.array(c, pa.int64()) for c in zip(*prints, strict=True)] or [pa.array([], pa.int64())] * WIDE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), _lists(firsts), *columns], names)

    return rows.select("who", f"`{text}`").mapInArrow(run, f"who {rows.schema['who'].dataType.simpleString()}, node long, n int, prefix array<long>, {_fields}")


def _paired(left: DataFrame, right: DataFrame, on: str, ratio: Ratio) -> DataFrame:
    """Distinct pairs (a, b) of members of a group whose sizes and places can be linked, if this is the first shingle that they share."""
    x, y = left.alias("x"), right.alias("y")
    out = x.join(y, F.expr(f"x.s = y.s and {on}") & F.expr(f"{ratio.both} * least(x.n - x.at, y.n - y.at) >= {ratio.p} * (x.n + y.n)"))
    return out.select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct()


def _pruned(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Those of the pairs whose wide fingerprints some chain of segments keeps near, or whose sets are small."""
    side = lambda at: prints.select(F.col("node").alias(at), F.col("n").alias(f"{at}_n"), *[F.col(f"f{i}").alias(f"{at}_{i}") for i in range(WIDE)])
    apart = [F.bit_count(F.col(f"a_{i}").bitwiseXOR(F.col(f"b_{i}"))) for i in range(WIDE)]
    return pairs.join(side("a"), "a").join(side("b"), "b").filter((F.least("a_n", "b_n") < SMALL) | chained(apart, WIDE_BITS)).select("a", "b")


def near_copies(rows: DataFrame, text: str = "text") -> DataFrame:
    """who, root (the same for all rows that links of at least 4/5 connect) for each row of identified(docs)."""
    found = stored(prefixes(rows, text), "prefixes")
    marked = found.select("who", "node")
    prints = found.filter("f0 is not null").select("node", "n", *[f"f{i}" for i in range(WIDE)]).dropDuplicates(["node"])
    entries = found.select("node", "n", F.posexplode("prefix").alias("at", "s"))
    sizes = entries.groupBy("s").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("size")).filter("least <> most").select("s", "least", "size")
    members = stored(entries.join(sizes, "s").distinct(), "members")

    return marked.join(connected(members, lambda pairs: _pruned(pairs, prints), rows, owners(marked), text), "node", "left").select("who", F.coalesce("root", "node").alias("root"))


def owners(marked: DataFrame) -> DataFrame:
    """node and its least who, stored; partial aggregates leave one a task, so a node may have any number of copies."""
    return stored(marked.groupBy("node").agg(F.min("who").alias("who")), "owners")


def connected(members: DataFrame, pruned: Callable[[DataFrame], DataFrame], rows: DataFrame, owned: DataFrame, text: str, ratio: Ratio = FOUR_FIFTHS, merged: bool = False, crowded: int | None = None) -> DataFrame:
    """node and root for each node with a link: what links between members(s, node, n, at, least, size) of the same group s connect.

    Every two nodes that are linked share a group; at is the place of s in the node's set, 0 where groups tell nothing of places. least and
    size are the group's least node and number of members. pruned drops pairs (a, b) that cannot be linked; whole sets tell of the others.
    owned are the owners of the nodes, whose rows have their texts.
    merged makes one of crowded groups that share members, so that a node has a set to tell apart once and not once for each group; the
    middles of such groups, of any size, are those of TOLD members, and no row is joined by a group that holds many.
    Groups of more than `crowded` nodes (CROWDED where it is not given) are crowded.
    """
    crowded = crowded or CROWDED
    small, large = members.filter(F.col("size") <= PAIRED), members.filter(F.col("size") > PAIRED)
    first = _paired(small, small, "x.node < y.node", ratio).union(_paired(large.filter("node = least"), large, "y.node <> x.node", ratio)).distinct()
    links = _similar(cut(pruned(first)), rows, owned, text, ratio)
    roots = cut(components(links))
    if large.head(1):
        rooted = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = rooted.groupBy("s").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a <> z").select("s")
        rest = cut(rooted.join(split, "s"))
        few = rest.filter((F.col("size") <= crowded) & F.expr("node <> least"))  # pairs with the least one of a group have been compared
        more, apart = _paired(few, few, "x.node < y.node and x.root <> y.root", ratio), None
        crowd = rest.filter(F.col("size") > crowded).select(F.col("least").alias("hub"), "node", "root").distinct()
        if merged:
            hubs = components(crowd.select(F.col("hub").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "hub")
            crowd = crowd.select("node", "root").distinct().join(hubs, "node").select("hub", "node", "root")
        crowd = cut(crowd)
        if crowd.head(1):
            apart = _apart(crowd, _sets_of(crowd.select("node").distinct(), rows, owned, text), ratio, sampled=merged)
            more = more.union(_central(apart)).distinct()
        more = cut(pruned(more))
        if more.head(1):
            links = links.union(_similar(more, rows, owned, text, ratio))
            roots = cut(components(links))
        if apart is not None:
            apart = apart.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            last = cut(pruned(_distant(apart, ratio, sampled=merged)))
            if last.head(1):
                links = links.union(_similar(last, rows, owned, text, ratio))
                roots = cut(components(links))
    return roots


def _sampled(held: DataFrame) -> DataFrame:
    """Of each hub's members some TOLD, chosen by hashes of their names; all of those that have no more."""
    sizes = stored(held.groupBy("hub").agg(F.count("*").alias("size")), "sizes")
    return matched(held, sizes, "hub").filter(F.pmod(F.xxhash64("node"), F.col("size")) < TOLD).drop("size")


def _middles(held: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each hub the shingles met often in its group, sorted, how many members differ from the middle in them, and whether the middle has them."""
    met = held.select("hub", F.explode("shingles").alias("s")).groupBy("hub", "s").count().filter(F.col("count") >= SEEN)
    top = met.orderBy(F.desc("count"), "hub", "s").limit(KNOWN).join(held.groupBy("hub").agg(F.count("*").alias("size")), "hub")
    table = top.select("hub", "s", "count", "size").orderBy("hub", "s").toArrow()
    hubs, s, count, size = (table.column(k).to_numpy().astype(np.int64) for k in range(4))
    begins = np.concatenate(([0], np.flatnonzero(hubs[1:] != hubs[:-1]) + 1, [len(hubs)])) if len(hubs) else np.zeros(1, np.int64)
    inside = 2 * count > size
    few = np.where(inside, size - count, count)
    return {int(hubs[a]): (s[a:b], few[a:b], inside[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)}


def _apart(groups: DataFrame, sets: DataFrame, ratio: Ratio, sampled: bool = False) -> DataFrame:
    """For each hub and member: n, d (shingles that set it apart from the group's middle), w (9 d - n at 4/5), the first of these in order, and the least (w, node) of the group.

    If sampled, TOLD members a group tell of its middle and of the order, which change what the work costs and not what is linked.
    """
    held = stored(groups.join(sets, "node").select("hub", "node", "root", "shingles"), "groups")
    shared = held.sparkSession.sparkContext.broadcast(_middles(_sampled(held) if sampled else held))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, apart, firsts = [], [], []
            for hub, value in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                found = value.values.to_numpy()
                often, few, inside = shared.value.get(hub, none)
                rank = np.zeros(len(found), np.int64)
                own, there = np.ones(len(found), bool), np.zeros(len(often), bool)
                if len(often):
                    at = np.minimum(np.searchsorted(often, found), len(often) - 1)
                    known = often[at] == found
                    there[at[known]] = True
                    rank[known] = few[at[known]]
                    own = ~(known & inside[at])
                lacks = inside & ~there
                each, rank = np.concatenate([found[own], often[lacks]]), np.concatenate([rank[own], few[lacks]])
                sizes.append(len(found))
                apart.append(len(each))
                firsts.append(each[np.lexsort((each, rank))][: ratio.apart * len(found) // ratio.p + 2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(apart, pa.int64()), _lists(firsts)], ["hub", "node", "root", "n", "d", "firsts"])

    out = stored(held.mapInArrow(run, "hub long, node long, root long, n long, d long, firsts array<long>").withColumn("w", F.expr(f"{ratio.both} * d - {ratio.apart} * n")), "apart")
    near = out.groupBy("hub").agg(F.min(F.struct("w", "node", "root")).alias("near"))
    return matched(out, stored(near, "nearest"), "hub") if sampled else out.join(near, "hub")


def _central(apart: DataFrame) -> DataFrame:
    """Pairs (a, b) of each group's member nearest to the middle with those so near that they are linked."""
    out = apart.filter("w + near.w <= 0 and root <> near.root")
    return out.select(F.expr("least(node, near.node)").alias("a"), F.expr("greatest(node, near.node)").alias("b")).distinct()


def _distant(apart: DataFrame, ratio: Ratio, sampled: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of members of a group not yet connected that share enough of what sets them apart, as far as sizes and places tell.

    Two members share o of these, and are linked if and only if 2 (p + q) o >= w + v (18 o at 4/5). Since o is e at most, and their sizes
    are within the ratio, v >= w - 2 (q - p) n q / p (2.5 n at 4/5); v is that of the nearest one at least and, as those near it are
    connected, beyond minus that for their partners.
    """
    least = F.expr("case when w + near.w > 0 then near.w else 1 - near.w end")
    o = F.greatest(F.lit(1), F.ceil((F.col("w") + F.greatest(least, F.floor(F.expr(f"w - {2 * ratio.apart * ratio.q} * n / {ratio.p}")))) / (2 * ratio.both)))
    apart = cut(apart) if sampled else apart
    split = apart.groupBy("hub").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a <> z").select("hub")
    rest = matched(apart, stored(split.withColumn("split", F.lit(True)), "split"), "hub").filter("split").drop("split") if sampled else apart.join(split, "hub")
    rest = rest.withColumn("far", F.expr("w + near.w > 0")).withColumn("o", o).filter("o <= d")
    rest = cut(rest.select("hub", "node", "root", "n", "d", "w", "far", F.posexplode(F.slice("firsts", F.lit(1), (F.col("d") - F.col("o") + 1).cast("int"))).alias("at", "s")))
    meets = rest.groupBy("hub", "s").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.max("far").alias("any")).filter("a <> z and any").select("hub", "s")
    rest = cut(rest.join(meets, ["hub", "s"]))
    on = "x.hub = y.hub and x.s = y.s and x.root <> y.root and x.far and (not y.far or x.node < y.node)"
    fits = f"{2 * ratio.both} * least(x.d - x.at, y.d - y.at) >= x.w + y.w and {ratio.q} * least(x.n, y.n) >= {ratio.p} * greatest(x.n, y.n)"
    out = rest.alias("x").join(rest.alias("y"), F.expr(on) & F.expr(fits))
    return out.select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct()


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left (stored) with the row of right (one for each key) that has its key, or nulls.

    Keys with more than a thousandth of left's rows are at most a thousand, so their rows of right go to every task; no other key is hot.
    """
    total = left.count()
    heavy = cut(left.groupBy(key).count().filter(F.col("count") * HEAVY > total).select(key))
    some = F.broadcast(heavy)
    of_heavy = F.broadcast(right.join(some, key, "left_semi"))
    return left.join(some, key, "left_semi").join(of_heavy, key, "left").union(left.join(some, key, "left_anti").join(right, key, "left"))


def listed(names: DataFrame, width: int) -> DataFrame:
    """A stored list of rows of some width, marked to be sent about if it is small."""
    return F.broadcast(names) if names.count() * width <= BROADCAST_BYTES else names


def _sets_of(nodes: DataFrame, rows: DataFrame, owned: DataFrame, text: str) -> DataFrame:
    """node and shingles for each of the nodes."""
    first = cut(owned.join(nodes, "node").select("who").distinct())
    return stored(_sets(rows.join(listed(first, 64), "who", "left_semi"), text), "sets").dropDuplicates(["node"])


def _similar(pairs: DataFrame, rows: DataFrame, owned: DataFrame, text: str, ratio: Ratio) -> DataFrame:
    """Those of the pairs of nodes whose sets reach the ratio."""
    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), rows, owned, text)
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return cut(pairs.join(x, "a").join(y, "b").filter(both * ratio.both >= (F.size("x") + F.size("y")) * ratio.p).select("a", "b"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each group of near copies: that of the least id, nulls last; of several rows with that id, the one of the least digest."""
    rows = identified(docs, key)
    found = stored(near_copies(rows, text), "near")
    # Survivors are found by their own names: partial aggregates keep a large group out of any one task, and nothing is joined by root.
    least = found.groupBy("root").agg(F.min("who").alias("who")).select("who", F.lit(True).alias("least"))
    told = cut(found.groupBy("who").agg(F.count("*").alias("n")).join(least, "who", "left").select("who", "n", F.col("least").isNotNull().alias("stays")).filter("n > 1 or not stays"))
    gone, again = told.filter("not stays").select("who"), told.filter("stays").select("who")
    plain = [F.col(f"`{c}`") for c in docs.columns]
    out = rows.join(listed(gone, 64), "who", "left_anti")
    if not again.head(1):
        return out.select(*plain)
    # Rows wholly alike; partial aggregates leave one a task, so any number of them may be.
    names = listed(again, 64)
    one = out.join(names, "who", "left_semi").select("who", F.struct(*plain).alias("doc")).groupBy("who").agg(F.first("doc").alias("doc"))
    return out.join(names, "who", "left_anti").select(*plain).union(one.select("doc.*"))
