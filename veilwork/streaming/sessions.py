"""Masking conversations as they come: a session's tokens are numbered on from micro-batch to micro-batch.

Detection is a projection and needs no state. State of a conversation is a keyed digest of each value with its token, and how many tokens
each category has; values themselves are never in it. Turns are numbered in their order (`streaming.state`), values of one turn from its end
to its start, as `masking.session_tokens` numbers them in batch, so both give the same tokens whatever the micro-batches. Turns that come
before their time wait in state with their texts. State goes with the row marked `last`, or when a conversation has been idle.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.config import Detect
from veilwork.functions import tokens as T
from veilwork.functions.spans import strip
from veilwork.operators.masking import detected
from veilwork.streaming.state import IDLE_MS, InOrder, in_order

_found = "array<struct<start:int,end:int,category:string,digest:string>>"
_pieces = "array<struct<start:int,end:int,token:string>>"


class Numbering(InOrder):
    """Gives each digest of a conversation its token."""

    fields = "role string, text string, found string, last boolean"

    def __init__(self, key: str, idle: int = IDLE_MS) -> None:
        super().__init__(idle)
        self.columns = (key, "seq", "role", "text", "pieces", "fresh")

    def opened(self, handle) -> None:
        self.tokens = handle.getMapState("tokens", "digest string", "token string")
        self.counts = handle.getMapState("counts", "category string", "n long")

    def begun(self, new: bool) -> None:
        self.numbers = {} if new else {k[0]: v[0] for k, v in self.counts.iterator()}

    def taken(self, key, seq, row):
        role, text, found, last = row
        pieces, fresh = [], []
        for d in sorted(json.loads(found or "[]"), key=lambda d: -d["start"]):
            place = {"start": d["start"], "end": d["end"]}
            if self.tokens.containsKey((d["digest"],)):
                token = self.tokens.getValue((d["digest"],))[0]
            else:
                n = self.numbers.get(d["category"], 0)
                token, self.numbers[d["category"]] = f"[{d['category']}_{n}]", n + 1
                self.tokens.updateValue((d["digest"],), (token,))
                fresh.append(place | {"token": token})
            pieces.append(place | {"token": token})
        return [(key, seq, role, text, json.dumps(pieces[::-1]), json.dumps(fresh))], bool(last)

    def kept(self) -> None:
        for category, n in self.numbers.items():
            self.counts.updateValue((category,), (n,))

    def ended(self) -> None:
        self.tokens.clear()
        self.counts.clear()


def masked_stream(rows: DataFrame, how: Detect, secret: str = "", key: str = "conv_id", order: str = "turn", values: bool = False, idle: int = IDLE_MS) -> DataFrame:
    """A stream of (key, order, role, text and, where it is there, last) with masked in place of text.

    order counts from 0 without gaps. With values, `fresh` maps the tokens that the row is the first to have to their values, for a store of
    the caller's that restores from them. secret keys the digests in state; a stream that goes on needs the same one. A null text stays null.
    """
    kind = rows.schema[key].dataType.simpleString()
    digest = lambda d: F.sha2(F.concat(F.lit(secret), F.lit("\0"), strip(d["text"])), 256)
    spans = F.transform("spans", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["category"].alias("category"), digest(d).alias("digest")))
    last = F.col("last") if "last" in rows.columns else F.lit(False)
    found = detected(rows, how).select(key, F.col(order).cast("long").alias("seq"), "role", "text", F.to_json(spans).alias("found"), last.alias("last"))
    out = in_order(found, key, Numbering(key, idle), f"`{key}` {kind}, seq long, role string, text string, pieces string, fresh string")
    masked = T.splice(T.escape(F.col("text")), F.from_json("pieces", _pieces)).alias("masked")
    said = lambda p: F.struct(p["token"], F.substring(F.col("text"), p["start"] + 1, p["end"] - p["start"]))
    fresh = [F.map_from_entries(F.transform(F.from_json("fresh", _pieces), said)).alias("fresh")] if values else []
    return out.select(key, F.col("seq").alias(order), "role", masked, *fresh)
