"""Chat formatting with loss masks, the template taken as a black box.

Prefixes of a conversation are rendered turn by turn. If a rendering does not begin with the one before, the template rewrites
history; that is reported and no spans are given. Otherwise what was added is the turn's span, and where its text lies in it is
seen by rendering the same prefix with a mark in the text's place.

Conversations are streamed in order of turns. A template is given whole prefixes, since it may look back as far as it likes, so its
work grows with the square of the turns. Only for a template declared turn_local (each turn is rendered without regard to others,
as by inst_template) the prefix is cut down to the last turn after BLOCK turns, if the next turn is rendered after it as after the
whole prefix; its work and memory stay bounded for conversations of any length, as of rows without an id.

Defined results: a null text or role is an empty one. Rows are ordered by turn, null first, then role, text; rows alike are turns
of their own. Rows with a null conv_id are one conversation, which is streamed, so its task holds no more of it than of any other.
Under the mask texts are un-escaped by the template's own `unescape`; a template without one is taken to escape nothing. An empty
table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm._common import table

BLOCK = 64
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: The template's control strings: <s>, </s>, [INST], [/INST]. In a text their first character and any backslash are escaped.
_escaped = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_said = re.compile(r"\\(.)", re.S)
_to, _from = {"\\": "\\\\", "<": "\\l", "[": "\\b"}, {"\\": "\\", "l": "<", "b": "["}
_turn = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return _escaped.sub(lambda m: _to[m[0]], text)


def unescape(text: str) -> str:
    return _said.sub(lambda m: _from[m[1]], text)


def inst_template(turns: list[Turn]) -> str:
    return "".join(f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns)


inst_template.turn_local, inst_template.unescape = True, unescape


def parse(formatted: str) -> list[Turn]:
    """The turns of what inst_template has rendered."""
    return [(unescape(r), unescape(t)) for r, t in _turn.findall(formatted)]


class Located:
    """Turns added one by one; for each the text that the template added and where the turn's text lies in it."""

    def __init__(self, template: Template, block: int = BLOCK) -> None:
        self.template, self.block = template, block
        self.prefix: list[Turn] = []
        self.before = ""
        self.local = getattr(template, "turn_local", False)
        self.rewrites = False

    def add(self, turn: Turn) -> tuple[str, int, int] | None:
        """None once the template has rewritten history."""
        now = self.template([*self.prefix, turn])
        if self.rewrites or not now.startswith(self.before):
            self.rewrites = True
            return None
        mark = "\ue000"
        while mark in now:
            mark += "\ue001"
        marked = self.template([*self.prefix, (turn[0], mark)])
        start = marked.find(mark, len(self.before))
        added = now[len(self.before) :]
        if start < 0 or not marked.startswith(self.before):  # the template drops the text
            span = (len(added), len(added))
        else:
            span = (start - len(self.before), len(added) - (len(marked) - start - len(mark)))
        if self.local and len(self.prefix) >= self.block:
            last = self.template(self.prefix[-1:])
            short = self.template([self.prefix[-1], turn])
            if short == last + added:
                self.prefix, self.before, now = self.prefix[-1:], last, short
            else:
                self.local = False
        self.prefix.append(turn)
        self.before = now
        return added, *span


def rewrites_history(template: Template, turns: list[Turn]) -> bool:
    located = Located(template)
    return any(located.add(t) is None for t in turns)


def formatted(rows: DataFrame, template: Template = inst_template, digest: bool = False, read: Callable[[str], list[Turn]] = parse) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text).

    formatted and spans (start, end in code points of formatted; one for each assistant text), or with digest what is read back
    from them: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. rewrites_history tells of the template.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    if digest:
        schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    else:
        schema = f"conv_id {kind}, formatted string, spans array<struct<start: long, end: long>>, rewrites_history boolean"
    names = [x.split(" ")[0] for x in schema.split(", ")][:7 if digest else 2] + ([] if digest else ["spans", "rewrites_history"])

    class Digest:
        def __init__(self) -> None:
            self.located, self.turns, self.loss = Located(template), hashlib.sha256(), hashlib.sha256()
            self.n = self.chars = self.loss_chars = 0

        def add(self, role: str, text: str) -> None:
            if (got := self.located.add((role, text))) is None:
                return
            added, start, end = got
            self.chars += len(added)
            for r, t in read(added):
                self.n += 1
                self.turns.update(f"{r}\n{t}\n".encode())
            if role == "assistant":
                said = getattr(template, "unescape", str)(added[start:end])
                self.loss_chars += len(said)
                self.loss.update(said.encode())

        def row(self) -> tuple:
            return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.located.rewrites

    class Whole:
        def __init__(self) -> None:
            self.located, self.parts, self.spans, self.all, self.chars = Located(template), [], [], [], 0

        def add(self, role: str, text: str) -> None:
            self.all.append((role, text))
            if (got := self.located.add((role, text))) is None:
                return
            added, start, end = got
            if role == "assistant":
                self.spans.append({"start": self.chars + start, "end": self.chars + end})
            self.parts.append(added)
            self.chars += len(added)

        def row(self) -> tuple:
            if self.located.rewrites:
                return template(self.all), [], True
            return "".join(self.parts), self.spans, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        made, at, state, begun = [], None, None, False
        for batch in batches:
            types = batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or conv != at:
                    if begun:
                        made.append((at, *state.row()))
                        if len(made) >= 1000:
                            yield pack(made, types)
                            made = []
                    at, state, begun = conv, (Digest if digest else Whole)(), True
                state.add(role or "", text or "")
        if begun:
            yield pack([*made, (at, *state.row())], types)

    def pack(made: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [key, *([pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()] if digest else [pa.string(), span, pa.bool_()])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]', r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
l AS (SELECT *, 20 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '\\|</?s>|\[/?INST\]')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, false AS rewrites_history FROM l GROUP BY conv_id"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return formatted(rows.unionByName(more), digest=True)
