"""Audit records as tables: made from masked texts, chained, verified, counted."""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.canonical import GENESIS, entry_hash
from veilwork.functions.shared import shared_folder
from veilwork.operators.audit_schema import violations
from veilwork.operators.schema_columns import schema_faults  # noqa: F401

HASHED = "file string, part long, line_no long, ok boolean, seq long, prev_hash string, stored string, computed string, violations array<string>"


def hashed(lines: DataFrame) -> DataFrame:
    """Each line with the hash it claims and the hash it has. The line itself is hashed, so what it lacks stays missing.

    lines have file, line_no, line and, as read_lines gives it, the part of the file; without it a file is one part.
    """
    types = [pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
    names = [x.split(" ")[0] for x in HASHED.split(", ")]

    def one(line: str) -> tuple:
        try:
            entry = json.loads(line)
            if not isinstance(entry, dict):
                raise ValueError
        except ValueError:
            return False, None, None, None, None, None
        seq, text = entry.get("seq", 0), lambda k: v if isinstance(v := entry.get(k), str) else None
        try:
            computed = entry_hash(entry)
        except ValueError:
            computed = None
        return True, seq if isinstance(seq, int) else None, text("prev_hash"), text("entry_hash"), computed, violations(entry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(one, batch.column(3).to_pylist()), strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], names)

    part = F.col("part") if "part" in lines.columns else F.lit(0)
    return lines.select("file", part.cast("long").alias("part"), F.col("line_no").cast("long").alias("line_no"), "line").mapInArrow(run, HASHED)


def linked(rows: DataFrame, order: str = "line_no", file: str = "file", stored: str = "stored", part: str | None = None, apart: bool = False) -> DataFrame:
    """rows with `expected`, the stored hash of the row before (as it is stored, right or not), or the genesis hash.

    Files, or with `part` the parts of files, are windows of their own; only the last hash of each goes on to the next, so no task holds the
    whole log, nor the whole of a large file. With `apart` each file is a chain of its own.
    """
    keys = [file] if part is None else [file, part]
    within = Window.partitionBy(*keys).orderBy(order)
    ends = rows.groupBy(*keys).agg(F.max_by(F.coalesce(F.col(stored), F.lit("")), order).alias("last"))
    ordered = Window.partitionBy(file).orderBy(*keys) if apart else Window.orderBy(*keys)
    names = [f"__{k}" for k in keys]
    starts = ends.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.lag("last", 1, GENESIS).over(ordered).alias("before"))  # a row for each part
    same = functools.reduce(operator.and_, [rows[k] == starts[n] for k, n in zip(keys, names, strict=True)])
    both = rows.join(starts, same)
    return both.withColumn("expected", F.coalesce(F.lag(F.coalesce(F.col(stored), F.lit("")), 1).over(within), F.col("before"))).drop(*names, "before")


def stored(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder once, for several uses."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def faults(lines: DataFrame, apart: bool = False) -> DataFrame:
    """(file, line_no, seq, fault): broken JSON, broken links, changed records. A line of broken JSON does not move the chain. With `apart` each
    file is a chain of its own."""
    return _faults(stored(hashed(lines)), apart)


def _faults(rows: DataFrame, apart: bool = False) -> DataFrame:
    good = linked(rows.filter("ok"), part="part", apart=apart)
    broken = rows.filter("not ok").select("file", "line_no", "seq", F.lit("invalid JSON").alias("fault"))
    link = F.when(~F.col("prev_hash").eqNullSafe(F.col("expected")), "chain broken")
    changed = F.when(~F.coalesce("stored", F.lit("")).eqNullSafe(F.col("computed")), "entry tampered")
    return broken.union(good.select("file", "line_no", "seq", F.explode(F.array_compact(F.array(link, changed))).alias("fault")))


def verify(lines: DataFrame, most: int = 1000) -> dict:
    """valid, the faults in order, and the highest seq; of many faults the first and error_count, how many there are. Lines are hashed once; `faults` is the whole table of faults."""
    rows = stored(hashed(lines))
    found = _faults(rows)
    first = [f"{r['file']}:{r['line_no']} seq={r['seq']} -- {r['fault']}" for r in found.orderBy("file", "line_no", "fault").limit(most).collect()]
    last = rows.agg(F.max("seq")).head()[0]
    more = {"error_count": found.count()} if len(first) == most else {}
    return {"valid": not first, "errors": first, "final_seq": last or 0} | more


def stats(records: DataFrame) -> dict:
    """Events by type, entities, categories, models."""
    row = records.agg(F.count("*").alias("n"), F.sum("entity_count").alias("entities"), F.collect_set("model").alias("models"), F.countDistinct("file").alias("files")).head()
    return {
        "total_events": row["n"], "total_entities": row["entities"] or 0, "models": sorted(row["models"]), "files": row["files"],
        "by_type": {r[0]: r[1] for r in records.groupBy("event_type").count().collect()},
        "categories": {r[0]: int(r[1]) for r in category_sums(records).collect()},
    }


def category_sums(records: DataFrame) -> DataFrame:
    """Sums of whole counts by category."""
    each = records.select(F.explode("categories").alias("category", "n")).filter("n = floor(n)")
    return each.groupBy("category").agg(F.sum("n").cast("long").alias("n"))


def metrics(records: DataFrame) -> DataFrame:
    """Calls, entities and time by event type."""
    return records.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("latency_ms").alias("total_ms"), F.avg("latency_ms").alias("avg_ms"), F.sum("entity_count").alias("entities"))


def chained(entries: DataFrame, order: str = "seq", chain: str | None = None, starts: DataFrame | None = None) -> DataFrame:
    """entries (order, entry as JSON text, and the chain's name) -> seq, entry, prev_hash, entry_hash.

    Without a chain's name there is one chain; a chain is serial, so it is folded in order by one task that streams it (streaming.shards parts a
    log into many). starts (chain, next, head) tells where chains go on; one that is not in it begins.
    """
    keys = [chain] if chain else []
    rows = entries.select(*keys, order, "entry")
    begin = [F.lit(0).cast("long").alias("__next"), F.lit(GENESIS).alias("__head")]
    if starts is not None:
        rows = rows.join(starts.select(chain, F.col("next").alias("__n"), F.col("head").alias("__h")), chain, "left")
        begin = [F.coalesce("__n", F.lit(0).cast("long")).alias("__next"), F.coalesce("__h", F.lit(GENESIS)).alias("__head")]
    rows = rows.select(*keys, order, *begin, "entry")
    rows = (rows.repartition(chain) if chain else rows.coalesce(1)).sortWithinPartitions(*keys, order, "entry").drop(order)
    fields = [f"{k} {entries.schema[k].dataType.simpleString()}" for k in keys] + ["seq long", "entry string", "prev_hash string", "entry_hash string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begun, seq, last = None, False, 0, GENESIS
        for batch in batches:
            seqs, texts, befores, hashes = [], [], [], []
            names = batch.column(0).to_pylist() if keys else [None] * batch.num_rows
            for name, first, head, text in zip(names, *(batch.column(batch.num_columns - k).to_pylist() for k in (3, 2, 1)), strict=True):
                if name != at or not begun:
                    at, begun, seq, last = name, True, first, head
                entry = {**json.loads(text), "seq": seq, "prev_hash": last}
                befores.append(last)
                entry["entry_hash"] = last = entry_hash(entry)
                seqs.append(seq)
                hashes.append(last)
                texts.append(json.dumps(entry, ensure_ascii=False))
                seq += 1
            arrays = [pa.array(seqs, pa.int64()), pa.array(texts, pa.string()), pa.array(befores, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays([*([batch.column(0)] if keys else []), *arrays], [*keys, "seq", "entry", "prev_hash", "entry_hash"])

    return rows.mapInArrow(run, ", ".join(fields))


def latency_bucket(ms):
    """Rounded to ten milliseconds, half to even: finer times would tell what was restored."""
    return F.bround(ms / 10) * 10
