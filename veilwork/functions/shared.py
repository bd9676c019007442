"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from veilwork.errors import ConfigError


def shared_folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; a folder of this machine only where it names none, as in tests."""
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="veilwork-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a folder; whether it is gone."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(folder, True)
    return not files.exists(folder)


#: Bytes of a table that is small enough to be dealt out anew.
SMALL = 20 << 20


def spread(table: DataFrame) -> DataFrame:
    """A small table of fewer splits than there are cores, dealt out over all cores; any other as it is.

    Work on texts is bound by CPU, so a shuffle of a few MB pays. Large tables have splits enough and are never shuffled for this.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    plan = table._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    if size <= SMALL and plan.toRdd().getNumPartitions() < cores:
        return table.repartition(cores)
    return table
