"""Numbering rows within groups of any size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.shared import shared_folder


def ranked(rows: DataFrame, groups: list[str], order: list[str], to: str = "rank", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with their place (from 0) in their group by `order`; the group may hold any share of all rows.

    Rows are dealt out by ranges of group and order, so a large group lies in many parts; a row's place is the number of its
    group's rows in the parts before, and its place in its own part. Only counts per part and group are windowed over a group.
    keep stores the rows dealt out; a checkpoint by default.
    """
    shared_folder(rows.sparkSession)
    names = [f"group_{i}" for i in range(len(groups))]
    dealt = (keep or (lambda d: d.checkpoint(eager=True)))(rows.repartitionByRange(*groups, *order).withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy(*groups).orderBy("part") if groups else Window.orderBy("part")
    counts = dealt.groupBy("part", *groups).agg(F.count("*").alias("n"))
    before = counts.select(F.col("part").alias("in_part"), *[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], (F.sum("n").over(upto) - F.col("n")).alias("before"))
    placed = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part", *groups).orderBy(*order)) - 1)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names, strict=True)], F.col("part") == F.col("in_part"))
    return placed.join(before, same).withColumn(to, F.col("before") + F.col("at")).drop("part", "in_part", "before", "at", *names)
