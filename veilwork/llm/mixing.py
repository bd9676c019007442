"""Mixing sources to target weights by weighted fair queueing, built-in functions only.

The documents of each source are shuffled (by a digest of their id) and may be taken up to `repeats` times, one round after the
other. A copy's virtual finish time is the tokens of its source up to its end, divided by the source's target; copies are sorted
by it over all sources and taken as long as the total stays within the budget. At virtual time 1 every source has given its target.

Running sums are taken in two levels, so that no task holds a whole source: documents are dealt out by ranges of source and place,
sums go over the ranges of a source, then within a range; likewise by slice of virtual time, then within the one slice where the
budget ends. Ranges part rows alike too, so neither one id nor null ids make a hot task. Slices are as many as the square root of the
number of documents. The mix itself is sorted globally by ranges of virtual finish time.

Defined results: a null text has size 0. A null source is a source like any other, sorted last; a null id is shuffled by its text.
Rows of equal id are queued in order of size and text; rows wholly alike follow one another and each takes its own place, so any of
them may be taken as often as it comes. A source of size 0 has target 0. An empty table gives an empty result. Columns besides those
named are carried along only by mixed(), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.llm._common import WORD, cut, identified, n_words_of, table

SEED = "mix-1"
#: Digits of the digest that order the shuffle; as many as fit a long.
DIGITS = 15


def shuffle_key(id_: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.lit(SEED + "-"), F.coalesce(id_.cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(text, F.lit("")))))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int, share: float) -> DataFrame:
    """source, source_size, target: one row per source; weights repeat over the sources in code point order, null last.

    A target is the lesser of repeats * source_size and weight * level, with the level at which they add up to the budget. Sources
    are few against documents; this runs on their sums only.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1).cast("long").alias("weight"))
    # In order of the level at which a source reaches its cap: those before have reached theirs.
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = ranked.select("source", "source_size", "weight", (F.col("source_size") * repeats).alias("cap"), F.coalesce(F.sum("source_size").over(before) * repeats, F.lit(0)).alias("capped"), (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"), (F.sum("source_size").over(every) * F.lit(share)).alias("budget"))
    d = d.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    # Each source that is capped leaves more to the others, until none is above its cap; to cap any further one would leave less.
    level = F.max("level").over(every)
    return d.select("source", "source_size", "budget", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def queued(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, share: float = 1.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """who (of identified), id, size, source, source_size, target, order, copies and finish (of each copy taken) for each row of docs.

    share: of the summed sizes, the budget.
    """
    rows, said = identified(docs, key), F.col(f"`{text}`")
    sized = rows.select("who", F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), F.coalesce(n_words_of(said), F.lit(0)).cast("long").alias("size"), shuffle_key(F.col(f"`{key}`"), said).alias("order"), F.unhex(F.md5(said)).alias("h"))
    sized = cut(sized.withColumn("row", F.monotonically_increasing_id()))
    slices_n = max(1, math.isqrt(sized.count()))
    goals = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats, share))
    place = ["order", "id", "size", "h", "row"]
    dealt = cut(sized.repartitionByRange("source", *place).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    offsets = sums.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = offsets.join(goals, same(offsets, goals)).select(offsets["source"].alias("s"), F.col("part").alias("p"), "offset", "source_size", "target", "budget")
    d = dealt.join(offsets, dealt["source"].eqNullSafe(offsets["s"]) & (dealt["part"] == offsets["p"]))
    within = Window.partitionBy("part", "source").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("offset") + F.sum("size").over(within)
    times = cut(d.select("who", "id", "source", "size", "order", "source_size", "target", "budget", end.alias("end")))

    due = lambda r: (F.lit(r) * F.col("source_size") + F.col("end")) / F.col("target")
    copies = times.filter("size > 0").select("size", "order", "id", "source", "budget", F.explode(F.array(*map(due, range(repeats)))).alias("finish"))
    slice_of = lambda c: F.floor(c * F.lit(float(slices_n)))
    slices = copies.groupBy(slice_of(F.col("finish")).alias("slice")).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"))
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = slices.withColumn("total", F.sum("n").over(upto)).filter("total > budget").orderBy("slice").select("slice", (F.col("total") - F.col("n")).alias("given")).head()
    # Copies of one source finish at different times, so no two share a place.
    order = ["finish", "order", F.col("source").asc_nulls_last()]
    cutoff = None
    if last is not None:  # within the slice where the budget ends
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut_slice = copies.filter(slice_of(F.col("finish")) == last["slice"]).withColumn("total", last["given"] + F.sum("size").over(upto))
        cutoff = cut_slice.filter("total > budget").orderBy(*order).select("finish", "order", F.col("source").isNull().alias("none"), "source").head()
    inside = lambda f: F.col("size") > 0
    if cutoff is not None:
        values = zip("abcd", cutoff, ("double", "long", "boolean", times.schema["source"].dataType), strict=True)
        there = F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in values])
        inside = lambda f: (F.col("size") > 0) & (F.struct(f.alias("a"), F.col("order").alias("b"), F.col("source").isNull().alias("c"), F.col("source").alias("d")) < there)
    finish = F.filter(F.array(*map(due, range(repeats))), inside)
    return times.select("who", "id", "size", "source", "source_size", "target", "order", finish.alias("finish")).withColumn("copies", F.size("finish").cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """For each document what the mix takes of it."""
    key = options.get("key", "doc_id")
    return queued(docs, **options).select(F.col("id").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, in order of virtual finish time."""
    out = cut(queued(docs, key=key, **options).select("who", "order", "finish"))
    rows = identified(docs, key)
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = rows.select("who", doc)
    again = cut(out.groupBy("who").count().filter("count > 1").select("who"))
    if again.head(1):  # rows wholly alike: one of them stands for all; partial aggregates leave one a task
        one = rows.join(again, "who", "left_semi").groupBy("who").agg(F.first("doc").alias("doc"))
        rows = rows.join(again, "who", "left_anti").union(one)
    taken = out.filter("size(finish) > 0").select("who", "order", F.explode("finish").alias("finish"))
    return rows.join(taken, "who").orderBy("finish", "order", "who").select("doc.*")


def sql_of(view: str = "documents") -> str:
    """The mix of a view with doc_id, text and source, one row per row, with copies."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id AS id, source, md5(text) AS h, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5('{SEED}-' || coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, '')))), 1, {DIGITS}) AS BIGINT) AS ord FROM {view}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
v AS (SELECT *, sum(source_size) OVER () AS budget, 3 * source_size AS cap,
  coalesce(sum(source_size) OVER b, 0) * 3 AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open FROM r
  WINDOW b AS (ORDER BY source_size / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(budget - capped AS DOUBLE) / open AS level FROM v),
t AS (SELECT source, source_size, budget, least(CAST(cap AS DOUBLE),
  max(level) OVER () * weight) AS target FROM l),
e AS (SELECT d.*, source_size, target, budget,
  sum(size) OVER (PARTITION BY d.source ORDER BY ord, id NULLS FIRST, size, h NULLS FIRST, rn ROWS UNBOUNDED PRECEDING) AS fin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT rn, source, size, ord, budget, (round_no * source_size + fin) / target AS finish
  FROM e, (SELECT unnest(range(3)) AS round_no) WHERE size > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY finish, ord, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS total FROM c),
n AS (SELECT rn, count(*) AS copies FROM k WHERE total <= budget GROUP BY rn)
SELECT e.id AS doc_id, e.size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(coalesce(copies, 0) * e.size AS BIGINT) AS taken, CAST(coalesce(copies, 0) AS BIGINT) AS copies
FROM e LEFT JOIN n ON e.rn = n.rn"""


SQL = sql_of()


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
