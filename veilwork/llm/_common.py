"""What the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.shared import removed, spread
from veilwork.functions.shared import shared_folder as shared_dir

#: A word is a run of anything but the six ASCII blanks. Java, Python and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by whatever path Spark can read; a small one of few splits is dealt out over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def cut(df: DataFrame) -> DataFrame:
    """df computed once and stored in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def identified(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with who(none, id, row): whether the id is null, the id, and a digest of the whole row. Only rows that are wholly alike share it."""
    row = F.xxhash64(*[part for c in docs.columns for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
    return docs.withColumn("who", F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("id"), row.alias("row")))


def text_of(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    """Number of words as long."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def passing(spark: SparkSession, path: str) -> str:
    """path, a folder that goes when this Python ends."""

    def drop() -> None:
        with contextlib.suppress(Exception):
            removed(spark, path)

    atexit.register(drop)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to a table of its own in the shared folder and read again; it goes when this Python ends."""
    spark = df.sparkSession
    path = passing(spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
