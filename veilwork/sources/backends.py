"""Detectors that are no patterns: an interface, a table function, and stand-ins.

A backend gets a text and the spans found so far and names more; what overlaps an earlier span is passed over. Backends run in
Arrow batches, in the order in which they are given.
"""

from __future__ import annotations

import ipaddress
import re
import socket
import urllib.parse
from abc import ABC, abstractmethod
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from veilwork.config import Detect
from veilwork.errors import ConfigError
from veilwork.functions.patterns import LLM_CATEGORIES, NER_LABELS, RESERVED, SPECIAL_CATEGORIES
from veilwork.functions.spans import CONFIDENCE, SPAN
from veilwork.sources.literals import Taken, placed

Span = dict


class Backend(ABC):
    """name: the spans' source."""

    name = "backend"

    @abstractmethod
    def detect(self, text: str, covered: list[tuple[int, int]]) -> list[Span]:
        """New spans (start, end, category, text, confidence, source); those that overlap `covered` are passed over later."""


class PatternBackend(Backend):
    """The patterns as a sequential scan, for comparison with the column engine."""

    name = "regex"

    def __init__(self, how: Detect) -> None:
        self.patterns = how.patterns()
        self.compiled = None

    def detect(self, text: str, covered: list[tuple[int, int]]) -> list[Span]:
        self.compiled = self.compiled or [(p.category, re.compile(p.regex)) for p in self.patterns]
        taken, out = Taken(covered), []
        for category, regex in self.compiled:
            for m in regex.finditer(text):
                if category == "PHONE" and len(re.sub(r"[-. ]", "", m[0])) < 7:
                    continue
                if not taken.take(m.start(), m.end()):
                    continue
                out.append({"start": m.start(), "end": m.end(), "category": category, "text": m[0], "confidence": CONFIDENCE, "source": self.name})
        return out


class NamedEntityBackend(Backend):
    """Any function text -> (label, start, end): labels become categories, spans under two characters are left out.

    load is called once per worker; if it fails, the backend finds nothing, unless it is required.
    """

    name = "ner"

    def __init__(self, load: Callable[[], Callable[[str], list[tuple[str, int, int]]]], kinds: frozenset[str] = frozenset({"PERSON", "ORG", "GPE"}), required: bool = False) -> None:
        self.load, self.kinds, self.required, self.model = load, kinds, required, None

    def detect(self, text: str, covered: list[tuple[int, int]]) -> list[Span]:
        if self.model is None:
            try:
                self.model = self.load()
            except Exception as e:
                if self.required:
                    raise ConfigError("the named-entity model cannot be loaded") from e
                self.model = lambda _: []
        out = []
        for label, start, end in self.model(text):
            category = NER_LABELS.get(label)
            if category in self.kinds and len(text[start:end].strip()) >= 2:
                out.append({"start": start, "end": end, "category": category, "text": text[start:end], "confidence": 0.85, "source": self.name})
        return out


class LanguageModelBackend(Backend):
    """ask: text -> (value, category) pairs. Values are placed wherever the text holds them, the longest first; texts met lately are not asked again."""

    name = "llm"

    def __init__(self, ask: Callable[[str], list[tuple[str, str]]], confidence: float = 0.8, more: tuple[str, ...] = (), special: bool = False, cache: int = 1024) -> None:
        self.ask, self.confidence, self.cache = ask, confidence, cache
        self.allowed = LLM_CATEGORIES | frozenset({"PERSON", "ORG"}) | frozenset(c for c in more if c not in RESERVED) | (SPECIAL_CATEGORIES if special else frozenset())
        self.known: OrderedDict[str, list] = OrderedDict()

    def answer(self, text: str) -> list[tuple[str, str]]:
        if text in self.known:
            self.known.move_to_end(text)
        else:
            self.known[text] = self.ask(text)
            if len(self.known) > self.cache:
                self.known.popitem(last=False)
        return self.known[text]

    def detect(self, text: str, covered: list[tuple[int, int]]) -> list[Span]:
        answers = [(v, c) for v, c in self.answer(text) if c in self.allowed]
        return [{"start": a, "end": b, "category": c, "text": v, "confidence": self.confidence, "source": self.name} for a, b, c, v in placed(text, answers, Taken(covered))]


def prompt(categories: list[str], locale: str | None = None) -> str:
    """What a language model is asked."""
    where = f" The text may be in the locale {locale}." if locale else ""
    return f"List sensitive values of the text as JSON: [{{\"value\": ..., \"category\": ...}}]. Categories: {', '.join(sorted(categories))}. Copy values exactly.{where}"


FIELDS = ("start", "end", "category", "text", "confidence", "source")
_arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("text", pa.string()), ("confidence", pa.float64()), ("source", pa.string())]))


def found_by(backends: list[Backend], text: str | None, known: list[Span] = ()) -> list[tuple]:
    """The spans of all backends and those known, by place, as tuples of FIELDS; what overlaps an earlier one is passed over."""
    out = [tuple(d[f] for f in FIELDS) for d in known or ()]
    taken = Taken((d[0], d[1]) for d in out)
    for backend in backends if text else ():
        for d in backend.detect(text, [(o[0], o[1]) for o in out]):
            if taken.take(d["start"], d["end"]):
                out.append(tuple(d[f] for f in FIELDS))
    return sorted(out, key=lambda d: d[0])


def with_backends(texts: DataFrame, backends: list[Backend], text: str = "text", to: str = "spans") -> DataFrame:
    """texts with the spans of all backends by place; spans that are there already come first."""
    before = to in texts.columns
    kept = [c for c in texts.columns if c != to]
    schema = texts.select(*kept).schema.add(to, ArrayType.fromDDL(f"array<{SPAN}>"))
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(len(kept)).to_pylist() if before else [[]] * batch.num_rows
            out = [[dict(zip(FIELDS, d, strict=True)) for d in found_by(backends, value, spans)] for value, spans in zip(batch.column(place).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(out, _arrow)], [*kept, to])

    return texts.select(*kept, *([to] if before else [])).mapInArrow(run, schema)


def asked_once(texts: DataFrame, ask: Callable[[str], list[tuple[str, str]]], confidence: float = 0.8, text: str = "text") -> DataFrame:
    """texts with `named`, the spans of a language model that is asked once for each distinct text, placed there and joined back by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(FIELDS, (a, b, c, v, confidence, "llm"), strict=True)) for a, b, c, v in placed(t, sorted(ask(t)))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _arrow)], ["digest", "named"])

    keyed = texts.withColumn("digest", F.sha2(text, 256))
    named = keyed.filter(F.col(text).isNotNull()).select("digest", text).dropDuplicates(["digest"]).mapInArrow(run, f"digest string, named array<{SPAN}>")
    return keyed.join(named, "digest", "left").drop("digest").withColumn("named", F.coalesce("named", F.expr(f"cast(array() as array<{SPAN}>)")))


#: Networks that a detector's address may not lie in, but for this machine if asked for.
_private = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8")]


def safe_url(url: str, local: bool = False, resolve: Callable[[str], list[str]] | None = None) -> bool:
    """Whether a detector's URL leads to a public address, or with local to this machine; every address of its name must."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username:
        return False
    resolve = resolve or (lambda h: [i[4][0] for i in socket.getaddrinfo(h, None)])
    try:
        found = [ipaddress.ip_address(a.split("%")[0]) for a in resolve(parts.hostname)]
    except (OSError, ValueError):
        return False
    plain = [getattr(a, "ipv4_mapped", None) or a for a in found]
    fine = lambda a: (local and a.is_loopback) or not any(a in n for n in _private if n.version == a.version)
    return bool(plain) and all(map(fine, plain))
