"""Tokens that stand for values: grammar, escaping, splicing, restoring, hashing."""

from __future__ import annotations

import hashlib
import hmac
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.spans import let, strip

#: Fixed values of the token grammar.
TOKEN = r"\[([A-Z][A-Z0-9_]*_(?:[0-9]+|REDACTED))\]"
MAX_TOKEN = 40
OPEN, CLOSE = "［", "］"
_parsed = r"^\[([A-Z][A-Z0-9_]*)_([0-9]+|REDACTED)\]$"


def escape(text: Column) -> Column:
    """Look-alikes of tokens get full-width brackets, one character for one, so places stay."""
    return F.regexp_replace(text, TOKEN, f"{OPEN}$1{CLOSE}")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, TOKEN.replace(r"\[", OPEN, 1).removesuffix(r"\]") + CLOSE, "[$1]")


def valid_token(token: Column) -> Column:
    return (F.length(token) <= MAX_TOKEN) & token.rlike(_parsed)


def token_category(token: Column) -> Column:
    """Null if it is no token."""
    return F.when(token.rlike(_parsed), F.regexp_extract(token, _parsed, 1))


def token_suffix(token: Column) -> Column:
    return F.when(token.rlike(_parsed), F.regexp_extract(token, _parsed, 2))


def is_redacted(token: Column) -> Column:
    return F.coalesce(token_suffix(token) == "REDACTED", F.lit(False))


def splice(text: Column, pieces: Column) -> Column:
    """text with each of pieces (an array of struct<start, end, token> by place, not overlapping) put in place of its span."""
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    at = lambda ps, i: F.coalesce(F.get(ps, i - 1)["end"], F.lit(0))

    def joined(ps: Column) -> Column:
        parts = F.transform(ps, lambda p, i: F.concat(cut(at(ps, i), p["start"]), p["token"]))
        tail = at(ps, F.size(ps))
        return F.concat(F.array_join(parts, ""), cut(tail, F.length(text)))

    return F.when(F.size(pieces) == 0, text).otherwise(let(pieces, joined))


def redact(text: Column, spans: Column) -> Column:
    """Irreversible: each span becomes [CATEGORY_REDACTED]."""
    token = lambda d: F.concat(F.lit("["), d["category"], F.lit("_REDACTED]"))
    return splice(escape(text), F.transform(spans, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), token(d).alias("token"))))


def tokens_in(text: Column) -> Column:
    """All tokens, in either case, from left to right."""
    return F.regexp_extract_all(text, F.lit("(?i)" + TOKEN), F.lit(0))


def restore(text: Column, values: Column) -> Column:
    """Tokens (in either case) become their values of the map (lower-case token -> value); then look-alikes are unescaped.

    One pass: a value that looks like a token is left alone.
    """
    between = F.split(text, "(?i)" + TOKEN, -1)
    said = lambda t: F.coalesce(F.element_at(values, F.lower(t)), t)
    part = lambda s: unescape(s)

    def joined(found: Column) -> Column:
        pairs = F.transform(found, lambda t, i: F.concat(part(F.element_at(between, i + 1)), said(t)))
        return F.concat(F.array_join(pairs, ""), part(F.element_at(between, -1)))

    return let(tokens_in(text), lambda found: F.when(F.size(found) == 0, unescape(text)).otherwise(joined(found)))


def present_tokens(text: Column, tokens: Column) -> Column:
    """Those of the array that the text holds as they are written, sorted."""
    return F.array_sort(F.filter(tokens, lambda t: F.contains(text, t)))


def case_variants(text: Column) -> Column:
    """How many tokens of the text are not in upper case."""
    return F.size(F.filter(tokens_in(text), lambda t: t != F.upper(t)))


def entity_hash(key_hex: str, category: Column, value: Column) -> Column:
    """HMAC-SHA256 of CATEGORY:value, the value stripped and in lower case, composed of sha2."""
    key = bytes.fromhex(key_hex) if re.fullmatch(r"(?:[0-9a-fA-F]{2})+", key_hex) else key_hex.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda n: bytes(b ^ n for b in key.ljust(64, b"\0"))
    inner = F.concat(F.lit(pad(0x36)), F.concat(category, F.lit(":"), F.lower(strip(value))).cast("binary"))
    return F.sha2(F.concat(F.lit(pad(0x5C)), F.unhex(F.sha2(inner, 256))), 256)


def derived_key(secret: bytes, info: bytes = b"", salt: bytes = b"\0" * 32) -> str:
    """HKDF-SHA256, one block, as hex."""
    fixed = hmac.new(salt, secret, hashlib.sha256).digest()
    return hmac.new(fixed, info + b"\x01", hashlib.sha256).hexdigest()


def version_pin(model: Column, deployment: Column, instruction: Column) -> Column:
    """model@deployment/instruction if all three are there, else null."""
    there = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    return F.when(there(model) & there(deployment) & there(instruction), F.concat(model, F.lit("@"), deployment, F.lit("/"), instruction))


def valid_id(value: Column) -> Column:
    """1 to 64 printable ASCII characters."""
    return F.coalesce(value.rlike(r"^[\x21-\x7E]{1,64}$"), F.lit(False))


def ulid(millis: Column, random_hex: Column) -> Column:
    """26 characters of Crockford's alphabet: 48 bits of time, 80 of chance (20 hex digits)."""
    alphabet = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    digit = lambda n: F.substring(F.lit(alphabet), (n + 1).cast("int"), F.lit(1))
    time = [digit(F.shiftright(millis, 5 * k).bitwiseAND(F.lit(31))) for k in range(9, -1, -1)]
    halves = [F.conv(F.substring(random_hex, 1 + 10 * h, 10), 16, 10).cast("long") for h in (0, 1)]
    chance = [digit(F.shiftright(h, 5 * k).bitwiseAND(F.lit(31))) for h in halves for k in range(7, -1, -1)]
    return F.concat(*time, *chance)


def too_long(text: Column, max_chars: int) -> Column:
    """Whether the text is over the cap; 0 lifts it."""
    return F.lit(False) if max_chars == 0 else F.length(text) > max_chars
