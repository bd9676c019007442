"""Masking and restoring with records: what was done to each text, without any value of it.

sanitized() masks a table of texts and gives a record a row, desanitized() restores and gives its own, entries() turns records into
JSON for audit.chained or AuditLog.append. Texts, tokens and records stay tables; a record is made in the same pass as its text.

Defined results: a null text stays null and is recorded like an empty one, with empty hashes; null keys and sessions are met like
any other; an empty table gives empty ones. Columns named decision_id, masked or restored are replaced, all others are carried
along. Rows that are wholly alike in key and text share a decision id. tokens_used are those of the row's own text. A table has no
time for each row, so latency_ms is 0.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.config import Mask
from veilwork.errors import ConfigError
from veilwork.functions import tokens as T
from veilwork.functions.canonical import text_hash
from veilwork.operators import attest
from veilwork.operators import masking as M
from veilwork.operators.audit_schema import checked

TOKENS = "key string, category string, token string"


@dataclass(frozen=True)
class Call:
    """What records say of the call besides the texts."""

    model: str | None = None
    provider: str | None = None
    deployment: str | None = None
    instruction: str | None = None

    def columns(self) -> dict[str, Column]:
        name = lambda v: F.lit(v).cast("string")
        return {"model": name(self.model), "provider": name(self.provider), "system_version_pin": T.version_pin(name(self.model), name(self.deployment), name(self.instruction))}


def hashed(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("")).otherwise(F.sha2(text, 256))


def counted(names: Column) -> Column:
    """How often each name occurs in an array."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(names)), lambda c: F.struct(c.alias("key"), F.size(F.filter(names, lambda x: x == c)).alias("value"))))


def decided(own: str | None, *parts: str) -> Column:
    """The caller's decision id, or one of the run and the row: a task that runs again gives the same."""
    now, run = int(datetime.now(UTC).timestamp() * 1000), uuid.uuid4().hex
    chance = F.substring(F.sha2(F.concat_ws("\0", F.lit(run), *[F.coalesce(F.col(p).cast("string"), F.lit("\1")) for p in parts]), 256), 1, 20)
    fresh = T.ulid(F.lit(now).cast("long"), chance)
    return F.coalesce(F.col(own).cast("string"), fresh) if own else fresh


def _details(d: Column, token: Column, value: Column, hash_key: str | None) -> Column:
    fields = [d["start"].alias("start"), d["end"].alias("end"), d["category"].alias("category"), (d["end"] - d["start"]).alias("length"), d["confidence"].alias("confidence"), d["source"].alias("source"), token.alias("token")]
    return F.struct(*fields, *([T.entity_hash(hash_key, d["category"], value).alias("entity_hash")] if hash_key else []))


def sanitized(texts: DataFrame, how: Mask, key: str = "doc_id", session: str | None = None, text: str = "text", call: Call = Call(), decision: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with masked and decision_id, tokens, records). Texts of a session share tokens; without one each key is a session."""
    s = session or key
    rows = texts.withColumn("decision_id", decided(decision, key, text))
    found = M.detected(rows, how.detect, text, "__spans" if how.mode == "redact" else "spans")
    if how.mode == "redact":
        mark = lambda d: F.concat(F.lit("["), d["category"], F.lit("_REDACTED]"))
        both = found.withColumn("__d", F.array_sort(F.transform("__spans", lambda d: _details(d, mark(d), d["text"], how.hash_key)))).drop("__spans")
        tokens = texts.sparkSession.createDataFrame([], TOKENS).withColumn(s, F.lit(None).cast(texts.schema[s].dataType))
    else:
        values = M.met(found.withColumn("__order", F.col(key)), s, "__order", text)
        tokens = M.session_tokens(values, s, "__order")
        whole = F.struct("start", "end", "category", "seen.confidence", "seen.source")
        named = M.alike(values.drop("__order").distinct(), tokens.select(s, "key", "token"), s, "key")
        details = named.groupBy(s, "of").agg(F.sort_array(F.collect_set(_details(whole, F.col("token"), F.col("key"), how.hash_key))).alias("d"))
        both = M.brought(rows, details, s, text, "d", M.few(values, "category")).withColumnRenamed("__what", "__d")
        both = both.withColumn("__d", F.coalesce("__d", F.array().cast(both.schema["__d"].dataType)))
    pieces = F.transform("__d", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["token"].alias("token")))
    both = both.withColumn("masked", T.splice(T.escape(F.col(text)), pieces))
    made = {
        "event_type": F.lit("sanitize"), "entity_count": F.size("__d"), "categories": counted(F.transform("__d", lambda d: d["category"])),
        "tokens_used": F.array_sort(F.array_distinct(F.transform("__d", lambda d: d["token"]))), "prompt_hash": hashed(F.col(text)), "sanitized_hash": hashed(F.col("masked")),
        "latency_ms": F.lit(0.0), "mode": F.lit(how.mode), "entity_details": F.col("__d"), "decision_id": F.col("decision_id"), **call.columns(),
    }
    return both.drop("__d"), tokens, _records(both, dict.fromkeys((key, s)), made)


def _records(rows: DataFrame, keys: dict[str, None], made: dict[str, Column]) -> DataFrame:
    """The keys as key_<name>, so that none clashes with a field of a record, and the record's fields."""
    return rows.select(*[F.col(k).alias(f"key_{k}") for k in keys], *[c.alias(n) for n, c in made.items()])


def desanitized(masked: DataFrame, tokens: DataFrame, key: str = "doc_id", session: str | None = None, text: str = "masked", call: Call = Call(), decision: str | None = None, mode: str = "tokenize") -> tuple[DataFrame, DataFrame]:
    """(masked with restored, records). Both hashes are of the masked text, so a record tells nothing of what was restored.

    The decision id is the caller's, else that of the masked row, if it has one. Only tokens that a text holds as they are written
    are recorded, with their categories; times are in steps of ten milliseconds.
    """
    s = session or key
    both = M.brought(masked, (values := M.held_values(masked, tokens, s, text)), s, text, "values", M.few(values.select(F.array_join(F.map_values("values"), "").alias("said")), "said"))
    known = F.coalesce("__what", F.expr("cast(map() as map<string,string>)"))
    both = both.withColumn("restored", T.restore(F.col(text), known))
    there = F.filter(T.tokens_in(F.col(text)), lambda t: (t == F.upper(t)) & F.map_contains_key(known, F.lower(t)))
    both = both.withColumn("__present", F.coalesce(F.array_sort(F.array_distinct(there)), F.expr("cast(array() as array<string>)")))
    inherited = [F.col(c).cast("string") for c in (decision, "decision_id") if c and c in masked.columns]
    made = {
        "event_type": F.lit("desanitize"), "entity_count": F.size("__present"), "categories": counted(F.transform("__present", T.token_category)), "tokens_used": F.col("__present"),
        "prompt_hash": hashed(F.col(text)), "sanitized_hash": hashed(F.col(text)), "latency_ms": F.lit(0.0), "mode": F.lit(mode),
        "decision_id": F.coalesce(*inherited) if inherited else F.lit(None).cast("string"), **call.columns(),
    }
    return both.drop("__what", "__present"), _records(both, dict.fromkeys((key, s)), made)


def batch_record(records: DataFrame, key: str = "doc_id", decision_id: str | None = None) -> dict:
    """One record for all the texts of sanitized(): sums, and the Merkle roots of the texts' hashes in place of the hashes, of which there may be any number."""
    total = records.agg(F.count("*").alias("n"), F.sum("entity_count").alias("entities")).head()
    by = records.select(F.explode("categories").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect()  # a row a category
    same = records.select("model", "provider", "system_version_pin", "mode").head()
    out = {
        "event_type": "sanitize_batch", "entity_count": total["entities"] or 0, "categories": {r["c"]: int(r["n"]) for r in sorted(by)}, "prompt_hash": "", "sanitized_hash": "",
        "decision_id": decision_id or records.sparkSession.range(1).select(decided(None, "id")).head()[0], "metadata": {"texts": total["n"]},
    }
    if total["n"]:
        for name, column in (("input_merkle_root", "prompt_hash"), ("output_merkle_root", "sanitized_hash")):
            leaves = records.select(F.col(f"key_{key}").alias("k"), F.when(F.col(column) == "", F.sha2(F.lit(""), 256)).otherwise(F.col(column)).alias("h"))
            out["metadata"][name] = attest.merkle_levels(attest.numbered(leaves, "k", "h"))[-1].head()["hash"]
    return checked(out | {k: v for k, v in (same.asDict() if same else {}).items() if v is not None})


def entries(records: DataFrame, *order: str) -> DataFrame:
    """records as (order, entry): JSON of the record's fields, nulls left out."""
    fields = [c for c in records.columns if not c.startswith("key_")]
    return records.select(*order, F.to_json(F.struct(*fields)).alias("entry"))


def alerts(scored: DataFrame, threshold: float = 0.7, score: str = "risk_score") -> DataFrame:
    """Rows whose risk is above the threshold."""
    return scored.filter(F.col(score) > threshold)


# Events without a text


def generation_record(modality: str, disclosure: str, synthetic: bool = True, labeled: bool = True, deepfake: bool = False, content: str | None = None, manifest_hash: str | None = None, decision_id: str | None = None) -> dict:
    """That something was generated: how it is marked and, of the content, only its hash."""
    context = {"modality": modality, "synthetic": synthetic, "labeled": labeled, "disclosure_method": disclosure, "deepfake": deepfake}
    context |= {k: v for k, v in (("content_hash", text_hash(content) if content is not None else None), ("c2pa_manifest_hash", manifest_hash)) if v is not None}
    return checked({"event_type": "content_generation", "content_context": context} | ({"decision_id": decision_id} if decision_id else {}))


def key_record(manifest: dict, public: bytes) -> dict:
    """That a key was registered; a manifest of another key is refused."""
    if manifest.get("key_id") != attest.key_id(public):
        raise ConfigError("the manifest is of another key")
    return checked({"event_type": "key_registered", "key_manifest": {k: v for k, v in manifest.items() if v is not None}})


def checkpoints_due(records: DataFrame, every: int) -> DataFrame:
    """Records after which the chain is to be stamped: each every-th of it, checkpoints themselves left out."""
    if every < 1:
        raise ConfigError("every must be 1 at least")
    return records.filter(((F.col("seq") + 1) % every == 0) & (F.col("event_type") != "chain_checkpoint"))
