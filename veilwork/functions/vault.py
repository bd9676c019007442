"""Where plain values are written on the way: a folder that is deleted.

Masking has to store the values that it met, so that texts are searched once. They go to the vault in force: that of the innermost `with
Vault(spark)`, whose folder is deleted at the end of the block, or the one of this Python, deleted when it ends. What a block returns must be
written before its end; `sealed` does this for a query: its result, which holds no value, is stored, and the vault is gone before it is returned.
Files are deleted, not overwritten.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from veilwork.errors import VeilError
from veilwork.functions.shared import removed, shared_folder

_current: ContextVar[Vault | None] = ContextVar("vault", default=None)


class Vault:
    """keep() stores a table in the vault's folder; wipe() deletes the folder and raises where it remains."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.tables = spark, f"{shared_folder(spark)}/values-{uuid.uuid4().hex}", 0

    def keep(self, rows: DataFrame) -> DataFrame:
        self.tables += 1
        schema, path = rows.schema, f"{self.path}/{self.tables}"
        rows.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def wipe(self) -> None:
        if self.tables and not removed(self.spark, self.path):
            raise VeilError(f"values remain in {self.path}")
        self.tables = 0

    def __enter__(self) -> Vault:
        self._token = _current.set(self)
        return self

    def __exit__(self, *_) -> None:
        _current.reset(self._token)
        self.wipe()


_own: dict[str, Vault] = {}


def vault(spark: SparkSession) -> Vault:
    """The vault in force."""
    if (now := _current.get()) is not None:
        return now
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = Vault(spark)
        atexit.register(_quietly, _own[app].wipe)
    return _own[app]


def _quietly(act: Callable[[], object]) -> None:
    with contextlib.suppress(Exception):
        act()


def passing(spark: SparkSession, what: str) -> str:
    """A folder of the shared one that goes when this Python ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_quietly, lambda: removed(spark, path))
    return path


def sealed(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose result holds no value, run in a vault of its own that is gone when it returns."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        with Vault(spark):
            out = query(spark, sf)
            path = passing(spark, "result")
            out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path)

    return run
