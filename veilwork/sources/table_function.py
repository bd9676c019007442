"""Detection as a table function: a row for each span of a text, for lateral joins in SQL.

    detect_spans(text [, only => 'EMAIL,IBAN'] [, locale => 'de'] [, custom => 'TICKET=T-\\d{6}'])

The arguments beside the text are constants. They are read, checked and compiled when the query is analysed: what is wrong with them stops
it there, and what was made of them reaches the workers as part of the plan. A text needs nothing of any other, so a lateral join is one pass
over the table without a shuffle, in Arrow batches. Spans are those of `masking.detected`, by place; a null or empty text has none. (LEFT JOIN
LATERAL does not keep texts without a span: Spark runs Python table functions as inner joins.)

An Arrow batch has up to 10,000 texts or 64 MB, and a worker holds it with its strings and those of the batch before. Rows without Arrow are pickled a
hundred at a time, whatever their bytes: little for short texts, but more than an executor's heap for texts of megabytes. So `entities` sends
short texts by rows and long ones in Arrow batches; the function and the spans are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from veilwork.config import Detect
from veilwork.errors import ConfigError
from veilwork.sources.backends import Backend, PatternBackend, found_by

NAME = "detect_spans"
BY_ROW = "detect_spans_by_row"
#: Bytes of a text that goes by rows: a hundred of them are 13 MB at most.
SHORT = 1 << 17


def span_schema() -> StructType:
    return StructType().add("start", IntegerType()).add("end", IntegerType()).add("category", StringType()).add("text", StringType()).add("confidence", DoubleType()).add("source", StringType())


@dataclass
class Planned(AnalyzeResult):
    """What analysis leaves for the workers."""

    how: Detect = field(default_factory=Detect)


def _said(name: str, value: AnalyzeArgument | None) -> str | None:
    if value is None:
        return None
    if not value.isConstantExpression or not isinstance(value.dataType, StringType) and value.value is not None:
        raise ConfigError(f"{name} must be a constant string")
    return value.value


def planned(text: AnalyzeArgument, only: AnalyzeArgument | None, locale: AnalyzeArgument | None, custom: AnalyzeArgument | None) -> Planned:
    if not isinstance(text.dataType, StringType):
        raise ConfigError(f"the text is of type {text.dataType.simpleString()}, not a string")
    names, where, own = _said("only", only), _said("locale", locale), _said("custom", custom)
    pairs = []
    if own:
        name, found, regex = own.partition("=")
        if not found:
            raise ConfigError("custom is NAME=regex")
        pairs.append((name.strip(), regex))
    chosen = None if names is None else tuple(n.strip() for n in names.split(",") if n.strip())
    how = Detect(locale=where, custom=tuple(pairs), only=chosen, max_chars=0)
    how.patterns()
    return Planned(schema=span_schema(), how=how)


class DetectSpans:
    """The patterns."""

    def __init__(self, result: Planned) -> None:
        self.backends: list[Backend] = [PatternBackend(result.how)]

    @staticmethod
    def analyze(text: AnalyzeArgument, only: AnalyzeArgument | None = None, locale: AnalyzeArgument | None = None, custom: AnalyzeArgument | None = None) -> Planned:
        return planned(text, only, locale, custom)

    def eval(self, text: str, only: str | None = None, locale: str | None = None, custom: str | None = None) -> Iterator[tuple]:
        yield from found_by(self.backends, text)


def register(spark: SparkSession, name: str = NAME, more: tuple[Backend, ...] = (), arrow: bool = True) -> None:
    """The table function under a name of SQL; more: backends of the caller's, which come after the patterns; arrow: in Arrow batches, not by rows."""

    class Detecting(DetectSpans):
        def __init__(self, result: Planned) -> None:
            super().__init__(result)
            self.backends += more

        @staticmethod
        def analyze(text: AnalyzeArgument, only: AnalyzeArgument | None = None, locale: AnalyzeArgument | None = None, custom: AnalyzeArgument | None = None) -> Planned:
            return planned(text, only, locale, custom)

        def eval(self, text: str, only: str | None = None, locale: str | None = None, custom: str | None = None) -> Iterator[tuple]:
            yield from found_by(self.backends, text)

    spark.udtf.register(name, udtf(Detecting if more else DetectSpans, useArrow=arrow))


def entities(rows: DataFrame, key: str, text: str = "text", more: tuple[Backend, ...] = (), **said: str) -> DataFrame:
    """A row for each span with the key of its text, by lateral joins; said: the constants. Workers' memory does not grow with the batches that splits fill."""
    spark = rows.sparkSession
    call = "".join(f", {name} => :{name}" for name in said)
    found = []
    for name, arrow, where in ((BY_ROW, False, F.octet_length(text) <= SHORT), (NAME, True, F.octet_length(text) > SHORT)):
        register(spark, name, more, arrow)
        found.append(spark.sql(f"SELECT r.`{key}`, s.* FROM {{rows}} r, LATERAL {name}(r.`{text}`{call}) s", said, rows=rows.select(key, text).filter(where)))
    return found[0].unionAll(found[1])
