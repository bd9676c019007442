"""Restoring tokens in streams of chunks.

State per stream is what may still become a token (at most MAX_TOKEN characters), the stream's tokens and two counts. Chunks are
taken in order of seq; whatever the cuts, the output joined together is the batch restore of the whole text. State ends with the
stream (`streaming.state`), so nothing of it stays.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.errors import StreamTooLong, VeilError
from veilwork.functions.tokens import CLOSE, MAX_TOKEN, OPEN
from veilwork.streaming.state import IDLE_MS, InOrder, in_order

_opening = re.compile(rf"[\[{OPEN}]")
_whole = re.compile(r"\[([A-Z][A-Z0-9_]*_(?:[0-9]+|REDACTED))\]", re.I)
_alike = re.compile(rf"{OPEN}([A-Z][A-Z0-9_]*_(?:[0-9]+|REDACTED)){CLOSE}")


@dataclass
class Restorer:
    """values: lower-case token -> value. feed() returns what is certain, flush() the rest."""

    values: dict[str, str]
    held: str = ""
    chars: int = 0
    cap: int = 0
    restored: int = field(default=0)

    def feed(self, chunk: str) -> str:
        self.chars += len(chunk)
        if self.cap and self.chars > self.cap:
            raise StreamTooLong(f"the stream is over {self.cap} characters")
        text, out, at = self.held + chunk, [], 0
        while m := _opening.search(text, at):
            out.append(text[at : m.start()])
            at = m.start()
            close = "]" if text[at] == "[" else CLOSE
            end = text.find(close, at + 1)
            again = _opening.search(text, at + 1)
            if again and (end < 0 or again.start() < end):  # no token holds a bracket
                out.append(text[at : again.start()])
                at = again.start()
                continue
            if end < 0:
                if len(text) - at <= MAX_TOKEN:
                    self.held = text[at:]
                    return "".join(out)
                out.append(text[at])
                at += 1
                continue
            out.append(self._said(text[at : end + 1]))
            at = end + 1
        self.held = ""
        return "".join([*out, text[at:]])

    def _said(self, piece: str) -> str:
        if m := _alike.fullmatch(piece):
            return f"[{m[1]}]"
        if _whole.fullmatch(piece) and (value := self.values.get(piece.lower())) is not None:
            self.restored += 1
            return value
        return piece

    def flush(self) -> str:
        out, self.held = self.held, ""
        return out


OUTPUT = "stream_id long, seq long, chunk string, is_summary boolean, chars_processed long, tokens_restored long, entity_count long, tokens_used array<string>, stream_error boolean, error_type string"
_columns = tuple(f.split()[0] for f in OUTPUT.split(", "))


class Restoring(InOrder):
    """State of a stream: what may still become a token, two counts, and its tokens; all of it goes with the last chunk, or when it is idle."""

    fields = "chunk string, last boolean, tokens string"
    columns = _columns

    def __init__(self, cap: int = 0, idle: int = IDLE_MS) -> None:
        super().__init__(idle)
        self.cap = cap

    def opened(self, handle) -> None:
        self.held = handle.getValueState("held", "held string, chars long, restored long, over boolean, known boolean")
        self.tokens = handle.getMapState("tokens", "token string", "value string, said string")

    def begun(self, new: bool) -> None:
        held, chars, restored, self.over, self.known = (None if new else self.held.get()) or ("", 0, 0, False, False)
        self.said = {k[0]: tuple(v) for k, v in self.tokens.iterator()} if self.known else {}
        self.new: dict[str, tuple[str, str]] = {}
        self.restorer = Restorer({k: v[0] for k, v in self.said.items()}, held, chars, self.cap, restored)

    def taken(self, key, seq, row):
        chunk, last, tokens = row
        if self.over:  # only the end is awaited
            return [], bool(last)
        for token, value in ((e["key"], e["value"]) for e in json.loads(tokens or "[]")):
            self.new[token.lower()] = self.said[token.lower()] = (value, token)
            self.restorer.values[token.lower()] = value
        try:
            out = self.restorer.feed(chunk or "") + (self.restorer.flush() if last else "")
        except VeilError as e:
            self.over = True
            summary = self._summary(key, seq, type(e).__name__)
            self._forget()
            return [(key, seq, "", *summary[3:])], bool(last)
        rows = [(key, seq, out, False, None, None, None, None, None, None)]
        return ([*rows, self._summary(key, seq, None)] if last else rows), bool(last)

    def _summary(self, key, seq, error: str | None) -> tuple:
        names = sorted(said for _, said in self.said.values())
        return (key, seq, "", True, self.restorer.chars, self.restorer.restored, len(names), names, error is not None, error)

    def _forget(self) -> None:
        if self.known:
            self.tokens.clear()
        self.known = False
        self.said, self.new, self.restorer.held, self.restorer.values = {}, {}, "", {}

    def kept(self) -> None:
        for token, value in self.new.items():
            self.tokens.updateValue((token,), value)
        self.held.update((self.restorer.held, self.restorer.chars, self.restorer.restored, self.over, self.known or bool(self.new)))

    def ended(self) -> None:
        self.held.clear()
        if self.known:
            self.tokens.clear()

    def expired(self, key, seq):
        """What is held comes out, then a summary that names the error; a stream over its cap has had its summary."""
        if self.over:
            return []
        summary = self._summary(key, seq, "StreamTimeout")
        return [(key, seq, self.restorer.flush(), False, None, None, None, None, None, None), summary]


def restored_stream(chunks: DataFrame, cap: int = 0, idle: int = IDLE_MS) -> DataFrame:
    """chunks (stream_id, seq, chunk, last, tokens map<string,string>) -> OUTPUT.

    seq counts from 0 without gaps; chunks are restored in its order whatever order they come in, and one that comes again is dropped. tokens may
    come with any row of a stream and stay known. After the row marked `last` the rest is flushed and exactly one summary row follows; so it
    does if the stream breaks its cap or nothing comes for `idle` milliseconds, and then error_type names the error. The summary has what
    audit records say of the stream (`stream_records`) and no value. After it nothing is kept of a stream but, beyond the cap, that its end is awaited.
    """
    # As text: Spark sizes its batches row by row, and for a map counts all rows of the batch each time.
    entries = F.when(F.size("tokens") > 0, F.to_json(F.map_entries("tokens"), {"ignoreNullFields": "false"}))
    return in_order(chunks.withColumn("tokens", entries), "stream_id", Restoring(cap, idle), OUTPUT)


def passed_stream(chunks: DataFrame) -> DataFrame:
    """chunks of streams without tokens (redacted ones, or nothing was found) -> OUTPUT: as they are, without any state; no character counts as processed."""
    none = lambda *names: [F.lit(None).alias(n) for n in names]
    said = F.struct(F.coalesce("chunk", F.lit("")).alias("chunk"), F.lit(False).alias("is_summary"), *none(*_columns[4:]))
    summary = F.struct(F.lit("").alias("chunk"), F.lit(True).alias("is_summary"), *[F.lit(0).alias(n) for n in _columns[4:7]], F.array().alias("tokens_used"), F.lit(False).alias("stream_error"), F.lit(None).alias("error_type"))
    kind = "struct<" + ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in OUTPUT.split(", ")[2:]) + ">"
    both = F.when(F.col("last"), F.array(said.cast(kind), summary.cast(kind))).otherwise(F.array(said.cast(kind)))
    return chunks.select("stream_id", "seq", F.explode(both).alias("r")).select("stream_id", "seq", "r.*")


def stream_records(out: DataFrame, model: str | None = None) -> DataFrame:
    """One audit record for each summary row of OUTPUT, with what the schema of records knows: no chunk and no value."""
    categories = F.transform("tokens_used", lambda t: F.regexp_extract(t, r"^\[(.*)_[^_]+\]$", 1))
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(categories)), lambda c: F.struct(c.alias("key"), F.size(F.filter(categories, lambda x: x == c)).alias("value"))))
    error = F.when(F.col("stream_error"), F.struct(F.lit(True).alias("stream_error"), F.col("error_type").alias("error_type"), F.col("chars_processed").alias("chars_processed")))
    metadata = F.when(F.col("stream_error"), F.to_json(error)).otherwise(F.to_json(F.struct(F.col("chars_processed").alias("chars_processed"))))
    return out.filter("is_summary").select(
        F.col("stream_id").alias("key_stream_id"), F.lit("desanitize_stream").alias("event_type"), F.lit(model).cast("string").alias("model"), F.col("entity_count").cast("int"),
        counts.alias("categories"), "tokens_used", metadata.alias("metadata"),
    )
