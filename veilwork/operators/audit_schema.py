"""What a record may hold, as one table of rules, and the list of violations of a record."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from veilwork.errors import SchemaViolation

# Fields of a record and of its parts, with their bounds.
FIELDS = frozenset(
    "seq event_id timestamp event_type model provider entity_count categories tokens_used prompt_hash sanitized_hash latency_ms mode "
    "entity_details timing certificate_hash key_id prev_hash entry_hash metadata risk_assessment compliance_version article_ref "
    "retention_hint_days pii_in_log bias_context decision_id system_version_pin key_manifest content_context checkpoint_context".split()
)
DETAIL_FIELDS = frozenset("category start end length confidence source token entity_hash text_index".split())
VALUE_KEYS = frozenset({"original_value", "original_text", "raw_text", "plain_text", "value", "text"})
CONTENT_KEYS = frozenset("content text output payload body data asset".split())
BIAS_EVENTS = frozenset({"bias_session_start", "bias_pseudonymise", "bias_finding", "bias_session_end"})
MAX_DEPTH, MAX_TEXT = 3, 256

Test = Callable[[object], bool]


def named(test: Test, *rule) -> Test:
    """test with the rule that it states, which `schema_columns` compiles to a column."""
    test.rule = rule
    return test


def text(most: int = 256, least: int = 0) -> Test:
    return named(lambda v: isinstance(v, str) and least <= len(v) <= most and "\0" not in v, "text", most, least)


def one_of(*values: str) -> Test:
    return named(lambda v: isinstance(v, str) and v in values, "one_of", *values)


def number(v: object) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def whole(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v >= 0


def flag(v: object) -> bool:
    return isinstance(v, bool)


def like(pattern: str, most: int) -> Test:
    compiled = re.compile(pattern)
    return named(lambda v: isinstance(v, str) and len(v) <= most and compiled.fullmatch(v) is not None, "like", pattern, most)


def metadata_faults(value: object, path: str, depth: int) -> Iterator[str]:
    if depth > MAX_DEPTH:
        yield f"{path}: nested too deeply"
    elif isinstance(value, str):
        if len(value) > MAX_TEXT:
            yield f"{path}: text over {MAX_TEXT} characters"
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from metadata_faults(v, f"{path}[{i}]", depth + 1)
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from metadata_faults(v, f"{path}.{k}", depth + 1)
    elif value is not None and not isinstance(value, bool | int | float):
        yield f"{path}: type {type(value).__name__}"


def _counts(v: object) -> bool:
    return isinstance(v, dict) and len(v) <= 64 and all(len(k) <= 32 and isinstance(n, int) and not isinstance(n, bool) for k, n in v.items())


def _names(v: object) -> bool:
    return isinstance(v, list) and len(v) <= 32 and all(isinstance(x, str) and len(x) <= 32 for x in v)


def _metrics(v: object) -> bool:
    return isinstance(v, dict) and len(v) <= 64 and not any(True for k, x in v.items() for _ in metadata_faults(x, k, 2))


for _test, _rule in ((number, "number"), (whole, "whole"), (flag, "flag"), (_counts, "counts"), (_names, "names"), (_metrics, "metrics")):
    named(_test, _rule)

#: Part -> (event types that may carry it, required fields, a test for each allowed field).
PARTS: dict[str, tuple[frozenset[str], frozenset[str], dict[str, Test]]] = {
    "bias_context": (
        BIAS_EVENTS, frozenset(),
        {"session_id": text(64), "purpose": text(500), "necessity_justification": text(2000), "categories_allowed": _names, "max_lifetime_seconds": number,
         "categories_used": _counts, "entity_count": number, "exit_reason": text(32), "wipe_confirmed": flag, "entries_processed": number,
         "duration_seconds": number, "finding_summary": text(500), "bias_metrics": _metrics},
    ),
    "key_manifest": (
        frozenset({"key_registered"}), frozenset("key_id public_key deployer_id valid_from purpose manifest_version manifest_hash".split()),
        {"key_id": text(64), "public_key": text(64), "deployer_id": text(256), "valid_from": text(64), "valid_until": text(64), "purpose": text(64),
         "manifest_version": text(16), "manifest_hash": text(128), "root_signature": text(256), "root_key_id": text(64)},
    ),
    "content_context": (
        frozenset({"content_generation"}), frozenset("modality synthetic labeled disclosure_method deepfake".split()),
        {"modality": one_of("text", "image", "audio", "video"), "synthetic": flag, "labeled": flag, "deepfake": flag, "c2pa_manifest_hash": text(128),
         "disclosure_method": one_of("c2pa", "watermark", "metadata", "visible_notice", "none"), "content_hash": text(128)},
    ),
    "checkpoint_context": (
        frozenset({"chain_checkpoint"}), frozenset("stamped_entry_hash tsa_url tst_token_b64 hash_algorithm stamped_seq".split()),
        {"stamped_entry_hash": like(r"[0-9a-fA-F]+", 128), "tsa_url": like(r"https://.*", 512), "tst_token_b64": like(r"[A-Za-z0-9+/=]+", 16384),
         "hash_algorithm": one_of("sha256", "sha512"), "stamped_seq": whole},
    ),
}


DECISION, PIN = like(r"[\x21-\x7E]{1,64}", 64), text(256)


def violations(entry: dict) -> list[str]:
    """Everything that the record may not hold; empty if it is fine."""
    return list(_violations(entry))


def _violations(entry: dict) -> Iterator[str]:
    for k in sorted(set(entry) - FIELDS):
        yield f"{k}: unknown field"
    details = entry.get("entity_details")
    if details and not isinstance(details, list):
        yield "entity_details: no list"
        details = None
    for i, detail in enumerate(details or []):
        if not isinstance(detail, dict):
            yield f"entity_details[{i}]: no object"
            continue
        for k in sorted(set(detail) - DETAIL_FIELDS):
            yield f"entity_details[{i}].{k}: " + ("a value of the text" if k in VALUE_KEYS else "unknown field")
    metadata = entry.get("metadata") or {}
    if not isinstance(metadata, dict):
        yield "metadata: no object"
    else:
        for k, v in metadata.items():
            yield from metadata_faults(v, f"metadata.{k}", 1)
    if (i := entry.get("decision_id")) is not None and not DECISION(i):
        yield "decision_id: not 1 to 64 printable characters"
    if (p := entry.get("system_version_pin")) is not None and not PIN(p):
        yield "system_version_pin: no text of at most 256 characters"
    for part, (events, required, tests) in PARTS.items():
        got = entry.get(part)
        if got is None:
            continue
        if not isinstance(got, dict):
            yield f"{part}: no object"
            continue
        if entry.get("event_type") not in events:
            yield f"{part}: not in a record of type {entry.get('event_type')}"
        for k in sorted(k for k in required if got.get(k) is None):
            yield f"{part}.{k}: missing"
        for k, v in got.items():
            if part == "content_context" and k in CONTENT_KEYS:
                yield f"{part}.{k}: content itself"
            elif k not in tests:
                yield f"{part}.{k}: unknown field"
            elif v is not None and not tests[k](v):
                yield f"{part}.{k}: bad value"
            elif v is None and part in ("bias_context", "checkpoint_context"):
                yield f"{part}.{k}: null"


def checked(entry: dict) -> dict:
    if found := violations(entry):
        raise SchemaViolation("; ".join(found))
    return entry
