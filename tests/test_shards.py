"""Logs in shards: batches taken once, folds equal to a loop, and what is lost or changed is found."""

import json
import shutil
from pathlib import Path

import pytest

from veilwork.errors import ChainIntegrityError, ConfigError
from veilwork.functions.canonical import GENESIS, entry_hash
from veilwork.streaming.shards import ShardedLog, shard_of
from pyspark.sql import functions as F

ENTRIES = "key string, order long, entry string, extra int"


def batch(spark, n, k, keys=True):
    rows = [(f"k{i}" if keys else None, i if i % 3 else None, json.dumps({"event_type": "sanitize", "metadata": {"i": i // 2}}), i) for i in range(k * n, (k + 1) * n)]
    return spark.createDataFrame(rows, ENTRIES)


def heads(log):
    return {r["shard"]: (r["next"], r["head"]) for r in log.heads().collect()}


def test_batches_equal_a_loop_and_are_taken_once(spark, tmp_path):
    log = ShardedLog(spark, str(tmp_path / "log"), 5)
    assert log.last() is None and log.records().count() == 0
    expected = {s: (0, GENESIS) for s in range(5)}
    for k in range(3):
        rows = batch(spark, 20, k, keys=k != 1)
        log.append(rows, k)
        log.append(rows, k)  # comes again
        placed = rows.select(shard_of(F.coalesce("key", "entry"), 5).alias("shard"), "order", "entry").collect()
        for r in sorted(placed, key=lambda r: (r["shard"], -1 if r["order"] is None else r["order"], r["entry"])):
            n, last = expected[r["shard"]]
            expected[r["shard"]] = (n + 1, entry_hash({**json.loads(r["entry"]), "seq": n, "prev_hash": last}))
        assert heads(log) == expected
    log.append(batch(spark, 0, 3), 3)  # an empty one
    assert heads(log) == expected and log.records().count() == 60
    assert log.faults(log.heads().head()["seal"]).count() == 0
    assert [r["fault"] for r in log.faults("x").collect()] == ["not the seal that was kept"]


def test_a_batch_lost_half_way_is_written_anew(spark, tmp_path):
    log = ShardedLog(spark, str(tmp_path / "log"), 3)
    log.append(batch(spark, 10, 0), 0)
    before = heads(log)
    log.append(batch(spark, 10, 1), 1)
    after = heads(log)
    shutil.rmtree(tmp_path / "log/heads/batch=1")  # records are there, the commit is not
    assert heads(log) == before and log.records().count() == 10
    log.append(batch(spark, 10, 1), 1)
    assert heads(log) == after and log.faults().count() == 0
    shutil.rmtree(tmp_path / "log/heads/batch=0")
    with pytest.raises(ChainIntegrityError):
        log.append(batch(spark, 10, 0), 0)
    with pytest.raises(ConfigError):
        ShardedLog(spark, str(tmp_path), 5000)


def rewritten(spark, path: Path, change):
    rows = change(spark.read.parquet(str(path))).collect()
    schema = spark.read.parquet(str(path)).schema
    shutil.rmtree(path)
    spark.createDataFrame(rows, schema).write.parquet(str(path))


@pytest.mark.parametrize(
    ("where", "change", "fault"),
    [
        ("records/batch=1", lambda d: d.filter("shard <> 2"), "records and head differ"),
        ("records/batch=0", lambda d: d.filter("seq <> 1"), "chain broken"),
        ("records/batch=0", lambda d: d.withColumn("entry", F.regexp_replace("entry", "sanitize", "desanitize")), "entry tampered"),
        ("heads/batch=0", lambda d: d.withColumn("head", F.when(F.col("shard") == 1, F.sha2("head", 256)).otherwise(F.col("head"))), "seal broken"),
        ("heads/batch=1", lambda d: d.filter("shard <> 0"), "seal broken"),
    ],
)
def test_what_is_lost_or_changed_is_found(spark, tmp_path, where, change, fault):
    log = ShardedLog(spark, str(tmp_path / "log"), 3)
    for k in range(2):
        log.append(batch(spark, 12, k), k)
    rewritten(spark, tmp_path / "log" / where, change)
    assert fault in {r["fault"] for r in log.faults().collect()}


def test_a_stream_appends(spark, tmp_path):
    log = ShardedLog(spark, str(tmp_path / "log"), 4)
    for k in range(2):
        batch(spark, 15, k).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(ENTRIES).parquet(str(tmp_path / "in"))
        log.stream(rows, str(tmp_path / "progress")).awaitTermination()
    assert log.records().count() == 30 and log.faults().count() == 0
