"""Detection as a column: arrays of spans, built-in functions only.

Spark has no function that finds all matches with their places. A mark is put around each match, and the text is cut at the marks: matches and
what lies between them come by turns, so running lengths give the places, and the pattern is searched for once. A text that has the mark
already is searched twice, for all matches (regexp_extract_all) and what lies between them (split). (?U) gives Java's classes the meaning that Python's have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.patterns import Pattern

SPAN = "struct<start:int,end:int,category:string,text:string,confidence:double,source:string>"
NONE = f"cast(array() as array<{SPAN}>)"
CONFIDENCE = 0.95
#: Python's white space, which strip() and split() go by.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


#: What every match of a pattern holds; a text without it is not searched. Each is much quicker to look for than the pattern.
NEEDS = {
    "EMAIL": "@", "JWT": "eyJ", "AWS_KEY": "AKIA|ASIA", "SSN": r"(?U)\d{3}", "CREDIT_CARD": r"(?U)\d{4}", "PHONE": r"(?U)\d\d",
    "IBAN": r"(?U)[A-Z]{2}\d\d", "IP_ADDRESS": r"(?U)\d\.\d|[A-Fa-f0-9:]:", "API_KEY": "[a-zA-Z0-9_-]{22}", "IL_ID": r"(?U)\d{9}",
}


#: What every match of a pattern begins with: one class of characters, looked at before the branches of the pattern are tried at each place.
FIRST = {
    "IBAN": "A-Z", "API_KEY": "spaktb", "AWS_KEY": "A", "JWT": "e", "PHONE_DE": "+0", "PHONE_DE_LAND": "+0", "VAT_DE": "D", "PHONE_FR": "+0", "NIR_FR": "12", "PHONE_ES": "+6-9", "NIE_ES": "XYZ",
    "PHONE_NL": "+0", "BSN_NL": "bs", "PHONE_IL": "+0", "PHONE_IL_LAND": "+0", "PHONE_CN": "+1", "PHONE_JP": "+0", "PHONE_JP_LAND": "+0", "MY_NUMBER_JP": "マm", "PHONE_RU": "+78", "PHONE_RU_LAND": "+78",
    "INN_RU": "иi", "PHONE_KR": "+01", "PHONE_KR_LAND": "+0", "PHONE_IT": "+3", "PHONE_IT_LAND": "+0", "CODICE_FISCALE_IT": "A-Z", "PHONE_PL": r"+\d", "PESEL_PL": "p", "NIP_PL": "n", "PHONE_PT": "+9",
    "PHONE_BR": "+(1-9", "PHONE_IN": "+6-9", "PAN_IN": "A-Z", "AADHAAR_IN": "aआu",
} | dict.fromkeys(("DNI_ES", "POSTAL_NL", "NATIONAL_ID_CN", "SNILS_RU", "RRN_KR", "CPF_BR"), r"\d")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _on(value: Column, body: str) -> Column:
    """body, SQL over t, with the value as t. As text such an expression is built in one step."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"t -> {body}")), 1)


#: A fold copies what it has made at every step, so sums over many matches go by blocks: in time that grows with the matches.
BLOCK = 64
_INTS = "cast(array() as array<int>)"
_BEGINS = f"aggregate(bs, named_struct('at', 0, 'out', {_INTS}), (acc, block) -> named_struct('at', acc.at + aggregate(block, 0, (n, v) -> n + v.gap + v.n), 'out', concat(acc.out, array(acc.at)))).out"
_WITHIN = f"aggregate(block, named_struct('at', begin, 'out', {_INTS}), (acc, v) -> named_struct('at', acc.at + v.gap + v.n, 'out', concat(acc.out, array(acc.at + v.gap)))).out"
#: Where each of gaps, an array of struct<gap, n>, begins, n long after its gap: first the blocks, then what is in them.
_STARTS = _let(f"transform(sequence(0, cast((size(gaps) - 1) / {BLOCK} as int)), b -> slice(gaps, b * {BLOCK} + 1, {BLOCK}))", "bs", f"flatten(zip_with(bs, {_BEGINS}, (block, begin) -> {_WITHIN}))")


#: A code point that is no character.
MARK = "\ufdd0"
_TURNS = "named_struct('m', filter(p, (x, i) -> i % 2 = 1), 's', filter(p, (x, i) -> i % 2 = 0))"


def _regex(pattern: Pattern) -> str:
    """With Python's classes, and the class that a match begins with, under the pattern's own flags."""
    first = f"(?=[{FIRST[pattern.category]}])" if pattern.category in FIRST else ""
    return "(?U)" + ("(?i)" if first and pattern.regex.startswith("(?i)") else "") + first + pattern.regex


def matches(text: Column, pattern: Pattern) -> Column:
    """All matches of one pattern, from left to right."""
    regex = _q(_regex(pattern))
    span = f"named_struct('start', at, 'end', at + length(said), 'category', {_q(pattern.category)}, 'text', said, 'confidence', {CONFIDENCE}D, 'source', 'regex')"
    gaps = "zip_with(slice(f.s, 1, size(f.m)), f.m, (s, said) -> named_struct('gap', length(s), 'n', length(said)))"
    placed = f"CASE WHEN size(f.m) = 0 THEN {NONE} ELSE cast(zip_with(f.m, {_let(gaps, 'gaps', _STARTS)}, (said, at) -> {span}) as array<{SPAN}>) END"
    twice = _let(f"named_struct('m', regexp_extract_all(t, {regex}, 0), 's', split(t, {regex}, -1))", "f", placed)
    once = _let(f"split(regexp_replace(t, {regex}, '{MARK}$0{MARK}'), '{MARK}', -1)", "p", f"CASE WHEN size(p) = 1 THEN {NONE} ELSE {_let(_TURNS, 'f', placed)} END")
    spans = f"CASE WHEN contains(t, '{MARK}') THEN {twice} ELSE {once} END"
    if need := NEEDS.get(pattern.category):
        spans = f"CASE WHEN t RLIKE {_q(need)} THEN {spans} ELSE {NONE} END"
    if pattern.category == "PHONE":
        spans = f"filter({spans}, d -> length(regexp_replace(d.text, '[-. ]', '')) >= 7)"
    return _on(text, spans)


#: Whether d overlaps none of acc, disjoint spans by place: the last of them that begins before d ends is found by halving.
_FREE = _let("aggregate(ps, 0, (n, p) -> CASE WHEN get(acc, n + p - 1).start < d.`end` THEN n + p ELSE n END)", "n", "n = 0 OR get(acc, n - 1).`end` <= d.start")
_KEPT = _let(f"filter(array({', '.join(str(1 << k) for k in range(24, -1, -1))}), p -> p <= size(acc))", "ps", f"filter(found, d -> {_FREE})")


def claimed(*candidates: Column) -> Column:
    """Arrays of spans in order of precedence -> one array by place: a span that overlaps one of an earlier array is passed over.

    Each array holds disjoint spans by place, as the matches of a pattern are.
    """
    step = f"(acc, found) -> CASE WHEN size(found) = 0 THEN acc WHEN size(acc) = 0 THEN found ELSE sort_array(concat(acc, {_KEPT})) END"
    return F.call_function("aggregate", F.array(*candidates), F.expr(NONE), F.expr(step))


def detect(text: Column, patterns: Iterable[Pattern], more: Iterable[Column] = ()) -> Column:
    """The spans of a text by place. more: arrays of spans of other detectors; they come after the patterns."""
    patterns = list(patterns)
    found = [matches(text, p) for p in patterns] + list(more)
    whole = claimed(*found) if found else F.expr(NONE)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.expr(NONE)).otherwise(whole)


def placed_values(text: Column, values: Column, confidence: float, source: str = "llm") -> Column:
    """Spans of the literal values (an array of struct<value, category>) that another detector has named, longest value first."""
    free = lambda acc, s, e: ~F.exists(acc, lambda a: (s < a["end"]) & (e > a["start"]))

    def place(acc: Column, v: Column) -> Column:
        parts = F.split(text, F.concat(F.lit(r"\Q"), F.replace(v["value"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E")), -1)
        starts = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, q: n + F.length(q)) + i * F.length(v["value"]))
        made = F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), (s + F.length(v["value"])).cast("int").alias("end"), v["category"].alias("category"), v["value"].alias("text"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source")).cast(SPAN))
        return F.concat(acc, F.filter(made, lambda d: free(acc, d["start"], d["end"])))

    longest = F.sort_array(F.transform(F.filter(values, lambda v: F.length(v["value"]) > 0), lambda v: F.struct((-F.length(v["value"])).alias("n"), v["value"].alias("value"), v["category"].alias("category"))))
    return F.sort_array(F.aggregate(longest, F.expr(NONE), place))
