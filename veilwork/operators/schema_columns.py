"""The rules of `audit_schema` compiled to columns over VARIANT: what records may not hold, found without a Python worker.

`faults` gives the same messages as `audit_schema.violations`, in order of keys instead of their order in the line. A line that is no JSON
object, or a null, has a null list; so has one that VARIANT refuses and Python's json reads: NaN, infinities, an object with one key twice. Whole
numbers beyond 38 digits count as broken ones, and those of 19 digits and more with .0 behind them as whole. Everything is taken as deep as the rules go, so a record's cost is that of its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.operators import audit_schema as S


def NONE() -> Column:  # noqa: N802
    return F.expr("cast(array() as array<string>)")


def _text(v: Column) -> Column:
    """A variant as JSON; its first character tells its type."""
    return F.coalesce(F.to_json(v), F.lit("null"))


def _is(v: Column, *first: str) -> Column:
    return F.substring(_text(v), 1, 1).isin(*first)


def _null(v: Column) -> Column:
    return _text(v) == "null"


def _empty(v: Column) -> Column:
    """Null, false, zero, or nothing in it."""
    return _text(v).isin("null", "false", '""', "[]", "{}") | F.coalesce(_is(v, "-", "0") & (F.try_variant_get(v, "$", "double") == 0), F.lit(False))


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _items(v: Column) -> Column:
    return F.when(_is(v, "["), F.try_variant_get(v, "$", "array<variant>"))


def _entries(v: Column) -> Column:
    return F.map_entries(F.when(_is(v, "{"), F.try_variant_get(v, "$", "map<string,variant>")))


def _matches(v: Column, pattern: str) -> Column:
    return F.rlike(v, F.lit(rf"(?d)\A(?:{pattern})\z"))


def metadata_faults(v: Column, path: Column, depth: int) -> Column:
    """As audit_schema.metadata_faults, unrolled to the depth that is allowed."""
    if depth > S.MAX_DEPTH:
        return F.array(F.concat(path, F.lit(": nested too deeply")))
    within = lambda v, at: metadata_faults(v, at, depth + 1)
    long = F.array(F.concat(path, F.lit(f": text over {S.MAX_TEXT} characters")))
    return (
        F.when(_is(v, '"'), F.when(F.char_length(_string(v)) > S.MAX_TEXT, long).otherwise(NONE()))
        .when(_is(v, "["), F.flatten(F.transform(_items(v), lambda x, i: within(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
        .when(_is(v, "{"), F.flatten(F.transform(_entries(v), lambda e: within(e["value"], F.concat(path, F.lit("."), e["key"])))))
        .otherwise(NONE())
    )


def _whole(v: Column) -> Column:
    """VARIANT keeps 1.0 as a decimal, printed as 1; whole numbers are a BIGINT, those beyond 64 bits a decimal of 19 digits or more."""
    return _matches(_text(v), "-?[0-9]+") & ((F.schema_of_variant(v) == "BIGINT") | (F.length(_text(v)) >= 19))


def _plain(v: Column, most: int) -> Column:
    return _is(v, '"') & (F.char_length(_string(v)) <= most)


#: Rule -> a condition on a variant that is not null.
RULES: dict[str, Callable[..., Column]] = {
    "text": lambda v, most, least: _plain(v, most) & (F.char_length(_string(v)) >= least) & (F.instr(_string(v), "\0") == 0),
    "one_of": lambda v, *values: _is(v, '"') & _string(v).isin(*values),
    "like": lambda v, pattern, most: _plain(v, most) & _matches(_string(v), pattern),
    "number": lambda v: _is(v, "-", *"0123456789"),
    "whole": lambda v: _whole(v) & _is(v, *"0123456789"),
    "flag": lambda v: _is(v, "t", "f"),
    "counts": lambda v: _is(v, "{") & (F.size(_entries(v)) <= 64) & F.forall(_entries(v), lambda e: (F.char_length(e["key"]) <= 32) & _whole(e["value"])),
    "names": lambda v: _is(v, "[") & (F.size(_items(v)) <= 32) & F.forall(_items(v), lambda x: _plain(x, 32)),
    "metrics": lambda v: _is(v, "{") & (F.size(_entries(v)) <= 64) & F.forall(_entries(v), lambda e: F.size(metadata_faults(e["value"], e["key"], 2)) == 0),
}


def holds(test: S.Test, v: Column) -> Column:
    """The column of a test of the rule table; null counts as false."""
    rule, *given = test.rule
    return F.coalesce(RULES[rule](v, *given), F.lit(False))


def _part(entry: Column, part: str) -> Column:
    events, required, tests = S.PARTS[part]
    got = F.try_variant_get(entry, f"$.{part}", "variant")
    event = _string(F.try_variant_get(entry, "$.event_type", "variant"))
    at = lambda k: F.concat(F.lit(f"{part}."), k)

    def field(e: Column) -> Column:
        k, v = e["key"], e["value"]
        if part == "content_context":
            out = F.when(k.isin(*S.CONTENT_KEYS), F.concat(at(k), F.lit(": content itself"))).when(~k.isin(*tests), F.concat(at(k), F.lit(": unknown field")))
        else:
            out = F.when(~k.isin(*tests), F.concat(at(k), F.lit(": unknown field")))
        out = out.when(_null(v), F.concat(at(k), F.lit(": null")) if part in ("bias_context", "checkpoint_context") else F.lit(None).cast("string"))
        for name, test in tests.items():
            out = out.when((k == name) & ~holds(test, v), F.concat(at(k), F.lit(": bad value")))
        return out

    wrong = F.when(~F.coalesce(event.isin(*events), F.lit(False)), F.concat(F.lit(f"{part}: not in a record of type "), F.coalesce(event, F.lit("None"))))
    missing = [F.when(_null(F.try_variant_get(got, f"$.{k}", "variant")), F.lit(f"{part}.{k}: missing")) for k in sorted(required)]
    within = F.concat(F.array(wrong, *missing), F.transform(_entries(got), field))
    return F.when(_null(got), NONE()).when(~_is(got, "{"), F.array(F.lit(f"{part}: no object"))).otherwise(F.array_compact(within))


def _details(entry: Column) -> Column:
    got = F.try_variant_get(entry, "$.entity_details", "variant")

    def one(detail: Column, i: Column) -> Column:
        at = F.concat(F.lit("entity_details["), i.cast("string"), F.lit("]"))
        unknown = F.filter(F.transform(_entries(detail), lambda e: e["key"]), lambda k: ~k.isin(*S.DETAIL_FIELDS))
        said = F.transform(F.array_sort(unknown), lambda k: F.concat(at, F.lit("."), k, F.when(k.isin(*S.VALUE_KEYS), ": a value of the text").otherwise(": unknown field")))
        return F.when(_is(detail, "{"), said).otherwise(F.array(F.concat(at, F.lit(": no object"))))

    return F.when(_empty(got), NONE()).when(_is(got, "["), F.flatten(F.transform(_items(got), one))).otherwise(F.array(F.lit("entity_details: no list")))


def _metadata(entry: Column) -> Column:
    got = F.try_variant_get(entry, "$.metadata", "variant")
    each = F.flatten(F.transform(_entries(got), lambda e: metadata_faults(e["value"], F.concat(F.lit("metadata."), e["key"]), 1)))
    return F.when(_empty(got), NONE()).when(_is(got, "{"), each).otherwise(F.array(F.lit("metadata: no object")))


def faults(line: Column) -> Column:
    """Everything that the record in a line of JSON may not hold, as array<string>."""
    entry = F.try_parse_json(line)

    def field(name: str, test: S.Test, said: str) -> Column:
        v = F.try_variant_get(entry, f"$.{name}", "variant")
        return F.when(~_null(v) & ~holds(test, v), F.array(F.lit(said))).otherwise(NONE())

    unknown = F.array_sort(F.filter(F.transform(_entries(entry), lambda e: e["key"]), lambda k: ~k.isin(*S.FIELDS)))
    parts = [
        F.transform(unknown, lambda k: F.concat(k, F.lit(": unknown field"))),
        _details(entry),
        _metadata(entry),
        field("decision_id", S.DECISION, "decision_id: not 1 to 64 printable characters"),
        field("system_version_pin", S.PIN, "system_version_pin: no text of at most 256 characters"),
        *[_part(entry, p) for p in S.PARTS],
    ]
    return F.when(_is(entry, "{"), F.concat(*parts))


def schema_faults(lines: DataFrame) -> DataFrame:
    """(file, line_no, violation), one row per violation."""
    return lines.select("file", "line_no", F.explode(faults(F.col("line"))).alias("violation"))
