"""A log of many chains that streams append to: one chain a shard, batches that are taken once, a root over the shards.

A record goes to a shard by its key's digest, so that no shard is hot and each chain is folded by a task of its own. A batch is written in two
steps: its records (records/batch=N), then the heads of all shards after it with their root and the log's seal (heads/batch=N), which is the
commit. A batch that comes again after its commit adds nothing; one that was lost half-way is written anew from the heads before it. So the
checkpoint of a stream and the log agree whatever is lost. The root of a batch is the Merkle root over all shards' heads, empty ones included;
its seal is the hash of the seal before and the root, so the whole log is pinned by one hash that can be kept elsewhere.

Defined results: entries are ordered by (order, entry) within a batch, null first; a null key counts as the entry's own text; equal rows are records of their
own; an empty batch moves the seal only. Batches come in order of their ids, as foreachBatch gives them; one older than the last that was not
committed raises. Other columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilwork.errors import ChainIntegrityError, ConfigError
from veilwork.functions.canonical import GENESIS
from veilwork.operators import audit
from veilwork.operators.blocktree import K, subtree

RECORDS = "shard int, seq long, entry string, prev_hash string, entry_hash string, batch long"
HEADS = "shard int, next long, head string, root string, seal string, batch long"


def shard_of(key: Column, shards: int) -> Column:
    """By the first eight hex digits of the key's SHA-256."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % shards).cast("int")


def _root(heads: DataFrame) -> DataFrame:
    """batch, root: over the digests of (shard, next, head) in order of shards; a batch has as many rows as the log has shards."""
    leaf = F.sha2(F.concat_ws("|", "shard", "next", "head"), 256)
    leaves = F.transform(F.array_sort(F.collect_list(F.struct("shard", leaf.alias("leaf")))), lambda s: s["leaf"])
    return heads.groupBy("batch").agg(leaves.alias("leaves")).select("batch", subtree(F.col("leaves"), K).alias("root"))


def _seal(before: Column, root: Column) -> Column:
    return F.sha2(F.concat(before, root), 256)


class ShardedLog:
    """The log in a folder that driver and executors share. The number of shards is part of the log; it has at most 2^K."""

    def __init__(self, spark: SparkSession, folder: str, shards: int = 64) -> None:
        if not 1 <= shards <= 1 << K:
            raise ConfigError(f"a log has 1 to {1 << K} shards")
        self.spark, self.folder, self.shards = spark, folder, shards
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        self._path, self._files = path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self, batch: int) -> bool:
        return self._files.exists(self._sub(f"heads/batch={batch}/_SUCCESS"))

    def _sub(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def last(self) -> int | None:
        """The last batch that was committed."""
        found = self._files.globStatus(self._sub("heads/batch=*/_SUCCESS"))
        return max((int(str(f.getPath().getParent().getName()).split("=")[1]) for f in found or []), default=None)

    def _read(self, what: str, schema: str) -> DataFrame:
        last = self.last()
        if last is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{what}").filter(F.col("batch") <= last)

    def records(self) -> DataFrame:
        """Of all batches that were committed."""
        return self._read("records", RECORDS)

    def heads(self) -> DataFrame:
        """Each shard after the last batch: next, the number of its records, and head, the hash of the last."""
        return self._read("heads", HEADS).filter(F.col("batch") == F.lit(self.last()))

    def append(self, entries: DataFrame, batch: int) -> None:
        """entries (key, order, entry as JSON text) as one batch."""
        last = self.last()
        if last is not None and batch <= last:
            if self._committed(batch):
                return
            raise ChainIntegrityError(f"batch {batch} comes after batch {last}")
        before = self.heads().select("shard", "next", "head").drop_duplicates(["shard"])
        seal = GENESIS if last is None else self.heads().select("seal").head()["seal"]
        placed = entries.select(shard_of(F.coalesce(F.col("key").cast("string"), "entry"), self.shards).alias("shard"), "order", "entry")
        records = audit.chained(placed, "order", "shard", before)
        records.write.mode("overwrite").parquet(f"{self.folder}/records/batch={batch}")
        written = self.spark.read.schema(RECORDS).parquet(f"{self.folder}/records/batch={batch}")
        new = written.groupBy("shard").agg((F.max("seq") + 1).alias("n"), F.max_by("entry_hash", "seq").alias("h"))
        shards = self.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"))
        after = shards.join(before, "shard", "left").join(new, "shard", "left").select(
            "shard", F.coalesce("n", "next", F.lit(0).cast("long")).alias("next"), F.coalesce("h", "head", F.lit(GENESIS)).alias("head"), F.lit(batch).cast("long").alias("batch")
        )
        root = _root(after).head()["root"]
        both = after.select("shard", "next", "head", F.lit(root).alias("root"), _seal(F.lit(seal), F.lit(root)).alias("seal"))
        both.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/heads/batch={batch}")

    def stream(self, entries: DataFrame, progress: str, **trigger) -> StreamingQuery:
        """A stream of entries to the log; progress is the stream's own folder."""
        return entries.writeStream.foreachBatch(self.append).option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start()

    def faults(self, seal: str | None = None) -> DataFrame:
        """(shard, seq, fault): changed records and broken links, shards whose records are not those of their heads, roots and seals that do not hold;
        with a seal that was kept elsewhere, whether it is the last one. Only heads come together in one task, a row for each shard and batch."""
        lines = self.records().select(F.lpad(F.col("shard").cast("string"), 5, "0").alias("file"), F.col("batch").alias("part"), F.col("seq").alias("line_no"), F.col("entry").alias("line"))
        chains = audit.faults(lines, apart=True).select(F.col("file").cast("int").alias("shard"), F.col("line_no").alias("seq"), "fault")
        there = self.records().groupBy("shard").agg(F.count("*").alias("n"), F.max_by("entry_hash", "seq").alias("h"))
        heads = self.heads().select("shard", "next", "head").join(there, "shard", "full")
        lost = heads.filter(~(F.coalesce("n", F.lit(0)).eqNullSafe(F.col("next")) & F.coalesce("h", F.lit(GENESIS)).eqNullSafe(F.col("head"))))
        lost = lost.select("shard", F.col("next").alias("seq"), F.lit("records and head differ").alias("fault"))
        all_heads = self._read("heads", HEADS)
        seals = all_heads.groupBy("batch").agg(F.max("root").alias("said"), F.max("seal").alias("seal"), F.count("*").alias("rows")).join(_root(all_heads), "batch")
        before = F.lag("seal", 1, GENESIS).over(Window.orderBy("batch"))
        bad = seals.withColumn("before", before).filter((F.col("said") != F.col("root")) | (F.col("seal") != _seal(F.col("before"), F.col("root"))) | (F.col("rows") != self.shards))
        found = chains.union(lost).union(bad.select(F.lit(None).cast("int"), "batch", F.lit("seal broken")))
        if seal is not None:
            ends = self.heads().agg(F.max("seal").alias("s")).filter(~F.col("s").eqNullSafe(F.lit(seal)))
            found = found.union(ends.select(F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit("not the seal that was kept")))
        return found.toDF("shard", "seq", "fault")
