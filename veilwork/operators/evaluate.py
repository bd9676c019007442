"""Quality of detection against labelled spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two spans share half of the smaller one."""
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    return (shared > 0) & (shared * 2 >= F.least(a_end - a_start, b_end - b_start))


def matched(pairs: DataFrame) -> DataFrame:
    """(sample, category, tp, fp, fn) by sample: detections in order each take the first open label of their category.

    pairs: (sample, found array<struct<start,end,category>>, labels array<...>), a row per sample; greedy matching is sequential
    within a sample, and samples are independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for sample, found, labels in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts: dict[str, list[int]] = {}
                free = [True] * len(labels := labels or [])
                for d in found or []:
                    hit = next((k for k, g in enumerate(labels) if free[k] and g["category"] == d["category"] and 2 * (s := min(d["end"], g["end"]) - max(d["start"], g["start"])) >= min(d["end"] - d["start"], g["end"] - g["start"]) and s > 0), None)
                    if hit is not None:
                        free[hit] = False
                    counts.setdefault(d["category"], [0, 0, 0])[0 if hit is not None else 1] += 1
                for k, g in enumerate(labels):
                    if free[k]:
                        counts.setdefault(g["category"], [0, 0, 0])[2] += 1
                rows += [(sample, c, *n) for c, n in counts.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["sample", "category", "tp", "fp", "fn"])

    kind = pairs.schema["sample"].dataType.simpleString()
    return pairs.select("sample", "found", "labels").mapInArrow(run, f"sample {kind}, category string, tp long, fp long, fn long")


def scores(counts: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 to four places from tp, fp, fn."""
    s = counts.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda n, d: F.when(d == 0, 0.0).otherwise(n / d)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(ratio(2 * p * r, p + r), 4)})


def coverage(labels: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each label with the share of its characters that any detection covers and its state: scrubbed, partial or raw.

    labels, found: (key, start, end, category). Covered stretches are merged per label, so overlaps count once.
    """
    lab = labels.select(key, F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("category").alias("gc"))
    both = lab.join(found.select(key, "start", "end", "category"), key, "left")
    meets = (F.col("start") < F.col("ge")) & (F.col("end") > F.col("gs"))
    cut = F.when(meets, F.struct(F.greatest("start", "gs").alias("a"), F.least("end", "ge").alias("b")))
    per = both.groupBy(key, "gs", "ge", "gc").agg(F.sort_array(F.collect_list(cut)).alias("cuts"), F.coalesce(F.bool_or(meets & (F.col("category") == F.col("gc"))), F.lit(False)).alias("right_category"))
    merged = F.aggregate("cuts", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to")), lambda acc, c: F.struct((acc["n"] + F.greatest(c["b"] - F.greatest(c["a"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], c["b"]).alias("to")))["n"]
    share = merged / (F.col("ge") - F.col("gs"))
    state = F.when(share >= 0.99, "scrubbed").when(share > 0, "partial").otherwise("raw")
    return per.select(key, F.col("gs").alias("start"), F.col("ge").alias("end"), F.col("gc").alias("category"), share.alias("share"), state.alias("state"), "right_category")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with the side; each side is read once. Rows alike count as often as they are there."""
    both = a.withColumn("__n", F.lit(1)).union(b.withColumn("__n", F.lit(-1)))
    left = both.groupBy(*a.columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0")
    side = F.when(F.col("__n") > 0, "a").otherwise("b").alias("side")
    return left.select(*a.columns, side, F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__n"))).alias("__k")).drop("__k")
