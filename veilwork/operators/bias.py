"""Sessions that pseudonymise declared spans of special categories, leave evidence and are wiped."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.errors import ScopeError, SessionState, SessionTimeout
from veilwork.functions.patterns import SPECIAL_CATEGORIES
from veilwork.functions.shared import removed, shared_folder
from veilwork.functions.spans import strip
from veilwork.operators import masking
from veilwork.operators.audit_schema import metadata_faults

MAX_LIFETIME_S, MAX_SPANS = 7 * 24 * 3600, 1024
_hidden = re.compile("[\u200e\u200f\u202a-\u202e\u2066-\u2069\x00-\x08\x0b-\x1f]")


class BiasSession:
    """A context manager. record takes each evidence record (a dict); values and tokens live in a folder of the session until its end."""

    def __init__(self, purpose: str, justification: str, categories: list[str], lifetime_s: int = 3600, record: Callable[[dict], object] = lambda e: None, clock: Callable[[], float] = time.monotonic) -> None:
        for name, text, most in (("purpose", purpose, 500), ("justification", justification, 2000)):
            if not text.strip() or len(text) > most or _hidden.search(text):
                raise ScopeError(f"{name} must be plain text of 1 to {most} characters")
        if not categories or set(categories) - SPECIAL_CATEGORIES:
            raise ScopeError(f"categories must be among {sorted(SPECIAL_CATEGORIES)}")
        if not 1 <= lifetime_s <= MAX_LIFETIME_S:
            raise ScopeError(f"lifetime must be 1 to {MAX_LIFETIME_S} seconds")
        self.id, self.categories, self.lifetime, self.clock, self.record = str(uuid.uuid4()), frozenset(categories), lifetime_s, clock, record
        self.state, self.tokens, self.entries, self.began = "open", None, 0, clock()
        self.spark, self.folder, self.tables, self.used = None, None, 0, {}
        self._say("bias_session_start", purpose=purpose, necessity_justification=justification, categories_allowed=sorted(categories), max_lifetime_seconds=lifetime_s)

    def _say(self, event: str, **context) -> None:
        self.record({"event_type": event, "bias_context": {"session_id": self.id, **context}})

    def _alive(self) -> None:
        if self.state != "open":
            raise SessionState(f"the session is {self.state}")
        if self.clock() - self.began > self.lifetime:
            self.end("timeout")
            raise SessionTimeout("the session's lifetime is over")

    def pseudonymise(self, texts: DataFrame, spans: DataFrame) -> DataFrame:
        """texts (id, text) with the spans (id, start, end, category) replaced by the session's tokens, as `masked`.

        Any number of tables: a value that an earlier one has met keeps its token, new ones are numbered on.
        """
        self._alive()
        spark = texts.sparkSession
        size = F.length("text")
        bad = texts.join(spans, "id").agg(
            F.count_if((F.col("start") < 0) | (F.col("end") > size) | (F.col("start") >= F.col("end"))).alias("outside"),
            F.count_if(~F.col("category").isin(*self.categories)).alias("scope"),
        ).head()
        most = spans.groupBy("id").count().agg(F.max("count")).head()[0] or 0
        if bad["outside"] or bad["scope"] or most > MAX_SPANS:
            raise ScopeError(f"{bad['outside']} spans outside their text, {bad['scope']} out of scope, {most} spans in a text")
        self.spark, self.folder = spark, self.folder or f"{shared_folder(spark)}/session-{self.id}"
        session, d = F.lit(self.id).alias("session"), F.explode_outer("spans").alias("d")
        found = masking.with_caller_spans(texts, spans, "id")
        met = found.select(session, "id", masking.text_id(F.col("text")).alias("of"), d).filter("d is not null")
        values = self._kept(met.select("session", "id", "of", "d.start", "d.end", "d.category", strip(F.col("d.text")).alias("key")))
        fresh = values if self.tokens is None else self._kept(values.join(self.tokens.select("key"), "key", "left_anti"))
        new = masking.session_tokens(fresh, "session", "id", keep=self._kept)
        number = F.regexp_extract("token", r"_(\d+)\]$", 1).cast("long")
        before = F.element_at(F.create_map(*[F.lit(x) for pair in self.used.items() for x in pair]), F.col("category")) if self.used else F.lit(0)
        new = self._kept(new.withColumn("token", F.concat(F.lit("["), "category", F.lit("_"), number + F.coalesce(before, F.lit(0)), F.lit("]"))))
        for category, n in new.groupBy("category").count().collect():  # one row a special category
            self.used[category] = self.used.get(category, 0) + n
        self.tokens = new if self.tokens is None else self.tokens.union(new)
        # What is returned holds no value and outlives the session.
        masked = masking.tokenized(found.withColumn("session", session), values, self.tokens, "session").select("id", "masked").checkpoint(eager=True)
        used = {r[0]: r[1] for r in values.groupBy("category").count().collect()}
        self.entries += 1
        self._say("bias_pseudonymise", categories_used=used, entity_count=sum(used.values()))
        return masked

    def _kept(self, rows: DataFrame) -> DataFrame:
        """rows stored in the session's own folder, the only place where values are written."""
        self.tables += 1
        path, kind = f"{self.folder}/{self.tables}", rows.schema
        rows.write.parquet(path)
        return self.spark.read.schema(kind).parquet(path)

    def finding(self, summary: str, **metrics: float) -> None:
        self._alive()
        if not summary or len(summary) > 500 or any(True for k, v in metrics.items() for _ in metadata_faults(v, k, 2)):
            raise ScopeError("a finding is a summary of at most 500 characters with numbers")
        self._say("bias_finding", finding_summary=summary, bias_metrics=metrics)

    def end(self, reason: str = "clean") -> None:
        """Deletes the session's folder and says whether it is gone; a second end does nothing. Files are deleted, not overwritten."""
        if self.state != "open":
            return
        self.state, self.tokens = "ended", None
        wiped = self.folder is None or removed(self.spark, self.folder)
        self._say("bias_session_end", exit_reason=reason, wipe_confirmed=wiped, entries_processed=self.entries, duration_seconds=round(self.clock() - self.began, 3))

    def __enter__(self) -> BiasSession:
        return self

    def __exit__(self, kind, *_) -> None:
        self.end("clean" if kind is None else "error")
