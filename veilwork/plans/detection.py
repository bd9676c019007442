"""Queries of detection, masking and risk, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.config import Detect, Mask
from veilwork.functions import tokens as T
from veilwork.functions.patterns import LOCALES, Pattern, registry
from veilwork.functions.risk import DESCRIPTORS, RELATIONS, assess
from veilwork.functions.shared import spread
from veilwork.functions.spans import detect
from veilwork.functions.vault import sealed, vault
from veilwork.operators import guard as G
from veilwork.operators import masking as M
from veilwork.plans.sql import masked_sql, q, spans_sql
from veilwork.sources import table_function

#: Conversations with null and repeated keys, in the language that Spark and DuckDB share.
ODD = {
    "conv_id": "CASE WHEN conv_id % 7 <> 0 THEN CAST(floor(conv_id / 2) AS BIGINT) END",
    "turn": "CASE WHEN turn % 3 <> 0 THEN CAST(floor(turn / 2) AS BIGINT) END",
    "role": "role",
    "text": "CASE WHEN conv_id % 3 = 0 THEN concat(text, ' u', CAST(conv_id % 11 AS {text}), '@example.com or v', CAST(turn AS {text}), '@example.com') ELSE text END",
}
#: Queries read whole tables and have no cap. The built-in patterns that RE2 can read too, and two patterns of ours: they stand for all wherever SQL checks a query.
PLAIN = Detect(max_chars=0, only=("EMAIL", "IBAN", "API_KEY", "AWS_KEY", "JWT"), custom=(("DOTTED_QUAD", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"), ("CARD_DIGITS", r"\b[3-6]\d{15}\b"), ("HEX_SECRET", r"\b[0-9a-f]{40}\b")))
ALL = Detect(max_chars=0)
EVERY = {"none": Detect(max_chars=0, only=PLAIN.only)} | {name: Detect(locale=name, only=(), max_chars=0) for name in LOCALES}
#: Values that texts of the tables seldom have, made from doc_id: {m} are six digits of it without zeros.
_M = "replace(lpad(CAST(doc_id % 1000000 AS {text}), 6, '0'), '0', '5')"
VALUES = {
    "VAT_DE": "'DE', {m}, '123'", "NIR_FR": "'1851299', {m}, '42'", "DNI_ES": "'12', {m}, 'H'", "NIE_ES": "'X1', {m}, 'L'", "POSTAL_NL": "substr({m}, 3, 4), ' AB'", "BSN_NL": "'bsn: ', {m}, '789'",
    "NATIONAL_ID_CN": "{m}, '19900101123X'", "MY_NUMBER_JP": "'my number: ', {m}, {m}", "SNILS_RU": "'1', substr({m}, 1, 2), '-', substr({m}, 3, 3), '-789 12'", "INN_RU": "'ИНН ', {m}, '1234'",
    "RRN_KR": "'900101-1', {m}", "CODICE_FISCALE_IT": "'RSSMRA', substr({m}, 1, 2), 'T10A', substr({m}, 3, 3), 'S'", "NIP_PL": "'NIP 1', substr({m}, 1, 2), '-', substr({m}, 3, 3), '-78-90'",
    "CPF_BR": "'1', substr({m}, 1, 2), '.', substr({m}, 3, 3), '.789-09'", "PAN_IN": "'ABCPK', substr({m}, 1, 4), 'L'", "AADHAAR_IN": "'Aadhaar: 2', substr({m}, 1, 3), ' 1', substr({m}, 4, 3), ' 1234'",
    "IBAN": "'GB82 WEST 12', substr({m}, 1, 2), ' 98', substr({m}, 3, 2), ' 76', substr({m}, 5, 2)", "API_KEY": "'sk-abcdefghij', {m}, 'klmnopqrst'", "AWS_KEY": "'AKIAABCDEFGHIJ', {m}",
    "JWT": "'eyJhbGciOiJIUzI.eyJ', {m}, 'abcdef.sigsigs', {m}",
}
#: Each text with the values of all categories after it.
PLANTED = "concat(coalesce(text, ''), " + ", ".join(f"' ; ', {v.format(m=_M)}" for v in VALUES.values()) + ")"
KEY = "00112233445566778899aabbccddeeff00112233445566778899aabbccddeeff"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet"))


def plain(spark: SparkSession, sf: str) -> DataFrame:
    return M.detected(docs(spark, sf), PLAIN)


def email_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    found = M.detected(docs(spark, sf).select("lang", "text"), Detect(only=("EMAIL",), max_chars=0))
    return found.groupBy("lang").agg(F.sum(F.size("spans")).cast("long").alias("emails"), F.count("*").alias("documents"))


def detect_spans(spark: SparkSession, sf: str) -> DataFrame:
    return M.entities(plain(spark, sf), "doc_id").select("doc_id", "start", "end", "category", "text", "confidence", "source")


def detect_by_table_function(spark: SparkSession, sf: str) -> DataFrame:
    """The same spans by the table function, in lateral joins."""
    own = PLAIN.custom[1]
    found = table_function.entities(docs(spark, sf), "doc_id", only=",".join(PLAIN.only), custom=f"{own[0]}={own[1]}")
    return found.select("doc_id", "start", "end", "category", "text")


def detect_spans_all(spark: SparkSession, sf: str) -> DataFrame:
    return M.entities(M.detected(docs(spark, sf), ALL), "doc_id")


def detect_pages_all(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("html").alias("text"))
    return M.entities(M.detected(pages, ALL), "page_id")


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.categories(plain(spark, sf))


def source_rollup(spark: SparkSession, sf: str) -> DataFrame:
    d = M.entities(plain(spark, sf), "source", "doc_id")
    return d.groupBy("source", "category").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def custom_pattern(spark: SparkSession, sf: str) -> DataFrame:
    how = Detect(max_chars=0, only=(), custom=(("SECRET_TOKEN", r'token = "[0-9a-f]{40}"'),))
    return M.entities(M.detected(docs(spark, sf), how), "doc_id").select("doc_id", "start", "end", "category")


def locale(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return M.entities(M.detected(docs(spark, sf), Detect(locale=name, only=("EMAIL",), max_chars=0)), "doc_id").select("doc_id", "start", "end", "category", "text")

    return run


def locale_values(spark: SparkSession, sf: str) -> DataFrame:
    """What each locale's patterns, and the built-in ones alone, find in whole texts that hold a value of every category; texts are read once."""
    rows = docs(spark, sf).select("doc_id", F.expr(PLANTED.format(text="STRING")).alias("text"))
    each = [F.struct(F.lit(name).alias("locale"), detect(F.col("text"), how.patterns()).alias("spans")) for name, how in EVERY.items()]
    found = rows.select("doc_id", F.explode(F.array(*each)).alias("f")).select("doc_id", "f.locale", F.explode("f.spans").alias("s"))
    return found.select("doc_id", "locale", "s.start", "s.end", "s.category", "s.text")


def analyze(spark: SparkSession, sf: str) -> DataFrame:
    a = M.analysis(plain(spark, sf), "doc_id")
    return a.select("doc_id", "entity_count", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["category"], e["start"], e["end"], e["text"])), ",").alias("entities"))


def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    return M.redacted(plain(spark, sf)).select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), F.length("masked").alias("n_chars"), F.size("spans").alias("entity_count"))


def by_source(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, the values met in them, and the tokens of each source, which is the session here."""
    values = M.met(plain(spark, sf), "source", "doc_id")
    return docs(spark, sf), values, M.session_tokens(values, "source", "doc_id")


def session_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return by_source(spark, sf)[2]


@sealed
def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    return M.tokenized(*by_source(spark, sf), "source").select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), F.length("masked").alias("n_chars"))


@sealed
def guard_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    """Records of masking by session, as a log gets them."""
    _, _, records = G.sanitized(docs(spark, sf), Mask(detect=PLAIN), session="source")
    return records.select(F.col("key_doc_id").alias("doc_id"), "event_type", F.col("entity_count").cast("long").alias("entity_count"), "prompt_hash", "sanitized_hash", F.array_join("tokens_used", ",").alias("tokens"))


@sealed
def guard_desanitize(spark: SparkSession, sf: str) -> DataFrame:
    """Records of restoring what was masked by session, with the digest of the text that came back."""
    masked, tokens, _ = G.sanitized(docs(spark, sf), Mask(detect=PLAIN), session="source")
    asked = vault(spark).keep(masked.select("doc_id", "source", "masked", F.concat(F.lit("d"), "doc_id").alias("decision_id")))  # masked once for all that follows
    rows, records = G.desanitized(asked, tokens, session="source")
    back = rows.select("doc_id", F.sha2("restored", 256).alias("restored_sha256"))
    said = records.select(F.col("key_doc_id").alias("doc_id"), "decision_id", F.col("entity_count").cast("long").alias("entity_count"), F.array_join("tokens_used", ",").alias("tokens"), "prompt_hash", (F.col("prompt_hash") == F.col("sanitized_hash")).alias("hides"))
    return said.join(back, "doc_id")


@sealed
def restore_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts come back as they were after masking by session and restoring."""
    texts, values, tokens = by_source(spark, sf)
    back = M.restored(M.tokenized(texts, values, tokens, "source"), tokens, "source")
    return back.groupBy("lang").agg(F.count("*").alias("documents"), F.sum((F.col("restored") == F.col("text")).cast("long")).alias("same"), F.sum((F.col("masked") != F.col("text")).cast("long")).alias("masked"))


@sealed
def present_tokens(spark: SparkSession, sf: str) -> DataFrame:
    texts, values, tokens = by_source(spark, sf)
    masked = M.tokenized(texts.join(values.select("source", "doc_id").distinct(), ["source", "doc_id"], "left_semi"), values, tokens, "source")
    return masked.select("doc_id", F.array_join(T.present_tokens(F.col("masked"), F.array_distinct(F.regexp_extract_all("masked", F.lit(T.TOKEN), F.lit(0)))), ",").alias("tokens"))


def entity_details(spark: SparkSession, sf: str) -> DataFrame:
    return M.entity_details(plain(spark, sf), "doc_id", hash_key=KEY)


def entity_hash_linkage(spark: SparkSession, sf: str) -> DataFrame:
    return M.linked(plain(spark, sf), "doc_id", KEY)


@sealed
def token_summary(spark: SparkSession, sf: str) -> DataFrame:
    return session_tokens(spark, sf).groupBy("source", "category").agg(F.count("*").alias("n"), F.max(F.length("token")).alias("longest"), F.sum(T.valid_token(F.col("token")).cast("long")).alias("valid"))


def token_grammar(spark: SparkSession, sf: str) -> DataFrame:
    """The token functions over words of texts dressed as tokens."""
    word = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)), F.upper))).alias("w")
    t = docs(spark, sf).select("doc_id", word).select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), "w", F.lit("_"), F.col("doc_id"), F.lit("]"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("["), "w", F.lit("_REDACTED]"))).otherwise(F.concat(F.lit("["), F.lower("w"), F.lit("_1]"))).alias("t"))
    return t.groupBy(T.valid_token(F.col("t")).alias("valid"), T.is_redacted(F.col("t")).alias("is_redacted"), T.token_suffix(F.col("t")).alias("suffix")).agg(F.count("*").alias("n"), F.max(T.token_category(F.col("t"))).alias("last_category"))


def escape_lookalikes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with look-alikes of tokens put in, escaped and unescaped."""
    t = docs(spark, sf).select("doc_id", F.concat(F.lit("[EMAIL_0] "), F.coalesce("text", F.lit("")), F.lit(" [A_B2_REDACTED] [a_1]")).alias("t"))
    e = T.escape(F.col("t"))
    return t.select("doc_id", F.sha2(e, 256).alias("escaped_sha256"), F.length(e).alias("n_chars"), F.sha2(T.unescape(e), 256).alias("back_sha256"))


def context_risk(spark: SparkSession, sf: str) -> DataFrame:
    masked = M.redacted(plain(spark, sf)).select("doc_id", assess(F.col("masked")).alias("r"))
    return masked.select("doc_id", "r.*").withColumn("warnings", F.array_join("warnings", "; "))


@sealed
def masked_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    mail = F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), F.concat("text", F.lit(" user"), F.col("conv_id"), F.lit("@example.com"))).otherwise(F.col("text"))
    masked, _ = M.masked_conversations(rows.withColumn("text", mail), Detect(only=("EMAIL",), max_chars=0))
    return masked.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


@sealed
def masked_odd_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The same where conversations and turns are null or shared by several texts."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr(*[f"{x.format(text='STRING')} AS {c}" for c, x in ODD.items()])
    masked, _ = M.masked_conversations(rows, Detect(only=("EMAIL",), max_chars=0))
    return masked.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


def skip_models(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select(F.concat("source", F.lit("/model")).alias("model"))
    return d.groupBy(M.skipped(F.col("model"), ("src1", "local/")).alias("skipped")).agg(F.count("*").alias("n"))


def category_registry(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(registry(), "category string, family string")


def text_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of whole texts; of an empty one an empty string."""
    d = docs(spark, sf)
    return d.select("doc_id", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "").otherwise(F.sha2("text", 256)).alias("prompt_hash"))


QUERIES = {
    "detect_email_by_lang": email_by_lang, "detect_spans": detect_spans, "detect_by_table_function": detect_by_table_function, "detect_spans_all": detect_spans_all, "detect_pages_all": detect_pages_all,
    "detect_category_counts": category_counts, "detect_source_rollup": source_rollup, "custom_pattern": custom_pattern, "analyze": analyze,
    "redact_documents": redact_documents, "session_tokens": session_tokens, "tokenize_documents": tokenize_documents, "guard_sanitize": guard_sanitize, "guard_desanitize": guard_desanitize,
    "restore_roundtrip": restore_roundtrip, "present_tokens": present_tokens, "entity_details": entity_details,
    "entity_hash_linkage": entity_hash_linkage, "token_summary": token_summary, "token_grammar": token_grammar,
    "escape_lookalikes": escape_lookalikes, "context_risk": context_risk, "masked_conversations": masked_conversations, "masked_odd_conversations": masked_odd_conversations,
    "skip_models": skip_models, "category_registry": category_registry, "prompt_hashes": text_digests, "locale_values": locale_values,
} | {f"locale_{name}": locale(name) for name in LOCALES}

_plain = spans_sql(PLAIN.patterns())
_by_source = spans_sql(PLAIN.patterns(), keys="source, doc_id")
_key = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"


def session_sql(patterns) -> str:
    """CTEs that end in `tokens` (source, key, category, token)."""
    return f"""{spans_sql(patterns, keys="source, doc_id")},
met AS (SELECT source, doc_id, -"start" AS back, category, {_key.format("text")} AS key FROM spans),
first AS (SELECT source, key, min(ROW(doc_id, back, category)) AS p FROM met GROUP BY source, key),
flat AS (SELECT source, key, p[1] AS doc_id, p[2] AS back, p[3] AS category FROM first),
tokens AS (SELECT source, key, category, '[' || category || '_' || (row_number() OVER (PARTITION BY source, category ORDER BY doc_id, back) - 1) || ']' AS token FROM flat)"""


def tokenized_sql(patterns) -> str:
    """CTEs that end in `masked` (source, doc_id, masked)."""
    pieces = f'pieces AS (SELECT s.source, s.doc_id, s."start", s."end", t.token FROM spans s JOIN tokens t ON s.source = t.source AND {_key.format("s.text")} = t.key)'
    return f"{session_sql(patterns)},\n{pieces},{masked_sql(keys='source, doc_id')}"


_session, _tokenized = session_sql(PLAIN.patterns()), tokenized_sql(PLAIN.patterns())
_of_text = "m.doc_id, coalesce(array_to_string(list_sort(list_distinct(list(p.token))), ','), '') AS tokens"
_hash = "CASE WHEN coalesce({0}, '') = '' THEN '' ELSE sha256({0}) END"
_meet = "FROM masked m JOIN documents d ON d.doc_id = m.doc_id LEFT JOIN pieces p ON p.doc_id = m.doc_id GROUP BY m.doc_id, d.text, m.masked"
_redacted = f"""{_plain},
pieces AS (SELECT doc_id, "start", "end", '[' || category || '_REDACTED]' AS token FROM spans),{masked_sql()}"""


def _hash_sql(category: str, value: str) -> str:
    """DuckDB has no HMAC; it is composed of sha256 over blobs, as in Spark."""
    key = bytes.fromhex(KEY)
    pad = lambda n: "".join(f"\\x{b ^ n:02X}" for b in key.ljust(64, b"\0"))
    inner = f"sha256(CAST('{pad(0x36)}' AS BLOB) || encode({category} || ':' || lower(trim({value}))))"
    return f"sha256(CAST('{pad(0x5C)}' AS BLOB) || unhex({inner}))"


_risk_words = ", ".join(q(w) for w in DESCRIPTORS)
_any_token = r"\[[a-zA-Z][a-zA-Z0-9_]*_(?:[0-9]+|[rR][eE][dD][aA][cC][tT][eE][dD])\]"
_ties = " UNION ALL ".join(f"SELECT doc_id, {q(p)} AS phrase, l, string_split(l, {q(p)}) AS parts FROM low WHERE contains(l, {q(p)})" for p in sorted(RELATIONS))
_risk = f"""{_redacted},
low AS (SELECT doc_id, masked, lower(masked) AS l, list_filter(regexp_split_to_array(lower(masked), '[\\x09-\\x0D\\x1C-\\x20]+'), lambda w: w <> '') AS ws FROM masked),
words AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM low),
told AS (SELECT doc_id, i, regexp_replace(regexp_replace(ws[i], '^[.,;:!?"''()\\[\\]]+', ''), '[.,;:!?"''()\\[\\]]+$', '') AS w, array_to_string(ws[greatest(i - 5, 1):i + 5], ' ') AS near FROM words),
d AS (SELECT doc_id, count(*) AS n, list(w ORDER BY i) AS ws FROM told WHERE w IN ({_risk_words}) AND regexp_matches(near, '{_any_token}') GROUP BY doc_id),
split AS ({_ties}),
place AS (SELECT doc_id, phrase, l, k, list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(phrase) AS at_ FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM split)),
r AS (SELECT doc_id, count(*) AS n, list(phrase ORDER BY phrase, k) AS ps FROM place
  WHERE regexp_matches(substr(l, CAST(greatest(at_ - 49, 1) AS BIGINT), CAST(least(at_, 50) AS BIGINT)), '{_any_token}') AND regexp_matches(substr(l, CAST(at_ + length(phrase) + 1 AS BIGINT), 50), '{_any_token}') GROUP BY doc_id),
s AS (SELECT low.doc_id, len(low.ws) AS n_words, len(regexp_extract_all(masked, '{_any_token}')) / greatest(len(low.ws), 1) AS density, coalesce(d.n, 0) AS nd, coalesce(r.n, 0) AS nr, d.ws AS dw, r.ps AS rp FROM low LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id)),
sc AS (SELECT *, least(1.0::DOUBLE, density * 1.5::DOUBLE + nd * 0.15::DOUBLE + nr * 0.2::DOUBLE) AS score FROM s)
SELECT doc_id, floor(density * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS token_density, CAST(nd AS INT) AS identifying_descriptors, CAST(nr AS INT) AS relationship_edges,
  floor(score * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS risk_score, CASE WHEN score > 0.7::DOUBLE THEN 'high' WHEN score > 0.3::DOUBLE THEN 'medium' ELSE 'low' END AS risk_level,
  coalesce(array_to_string(list_concat(list_transform(coalesce(dw, []), lambda w: 'Identifying descriptor ''' || w || ''' near a token'), list_transform(coalesce(rp, []), lambda p: 'Relationship ''' || p || ''' connects tokens'))[1:5], '; '), '') AS warnings FROM sc"""

_values = "WITH planted AS MATERIALIZED (SELECT doc_id, " + PLANTED.format(text="VARCHAR") + " AS text FROM documents)\n" + "\nUNION ALL ".join(
    f"SELECT doc_id, {q(name)} AS locale, \"start\", \"end\", category, text FROM ({spans_sql(how.patterns(), view='planted')} SELECT * FROM spans)" for name, how in EVERY.items())

_email = Pattern("EMAIL", next(p.regex for p in ALL.patterns() if p.category == "EMAIL"))
_conv = f"""WITH rows_ AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN text || ' user' || conv_id || '@example.com' ELSE text END AS text FROM conversations),
{spans_sql([_email], view="rows_", keys="conv_id, turn").removeprefix("WITH ")},
first AS (SELECT conv_id, text AS key, min(ROW(turn, -"start")) AS p FROM spans GROUP BY conv_id, text),
tokens AS (SELECT conv_id, key, '[EMAIL_' || (row_number() OVER (PARTITION BY conv_id ORDER BY p[1], p[2]) - 1) || ']' AS token FROM first),
pieces AS (SELECT s.conv_id, s.turn, s."start", s."end", t.token FROM spans s JOIN tokens t ON s.conv_id = t.conv_id AND s.text = t.key),{masked_sql(keys="conv_id, turn", view="rows_")}
SELECT r.conv_id, r.turn, r.role, sha256(m.masked) AS text_sha256 FROM rows_ r JOIN masked m ON r.conv_id = m.conv_id AND r.turn = m.turn
UNION ALL SELECT DISTINCT conv_id, -1, 'system', sha256({q(M.HINT)}) FROM tokens"""

_odd = f"""WITH rows_ AS (SELECT {", ".join(f"{x.format(text='VARCHAR')} AS {c}" for c, x in ODD.items())} FROM conversations),
each AS (SELECT DISTINCT conv_id, turn, text, md5(text) AS h FROM rows_),
{spans_sql([_email], view="each", keys="conv_id, turn, h").removeprefix("WITH ")},
met AS (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn NULLS FIRST, h, "start" DESC) AS k FROM spans),
tokens AS (SELECT conv_id, text AS key, '[EMAIL_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h, "start" DESC) - 1) || ']' AS token FROM met WHERE k = 1),
texts_of AS (SELECT DISTINCT conv_id, h, text FROM each),
pieces AS (SELECT DISTINCT s.conv_id, s.h, s."start", s."end", t.token FROM spans s JOIN tokens t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.text = t.key),{masked_sql(keys="conv_id, h", view="texts_of")}
SELECT r.conv_id, r.turn, r.role, sha256(m.masked) AS text_sha256 FROM rows_ r JOIN masked m ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND md5(r.text) = m.h
UNION ALL SELECT DISTINCT conv_id, -1, 'system', sha256({q(M.HINT)}) FROM tokens"""

SQL = {
    "detect_email_by_lang": spans_sql([_email]) + " SELECT lang, CAST(count(s.doc_id) AS BIGINT) AS emails, count(DISTINCT d.doc_id) AS documents FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY lang",
    "detect_by_table_function": spans_sql(Detect(max_chars=0, only=PLAIN.only, custom=PLAIN.custom[1:2]).patterns()) + ' SELECT doc_id, "start", "end", category, text FROM spans',
    "detect_spans": _plain + ' SELECT *, 0.95::DOUBLE AS confidence, \'regex\' AS source FROM spans',
    "detect_category_counts": _plain + " SELECT category, count(*) AS n FROM spans GROUP BY category",
    "detect_source_rollup": _by_source + " SELECT source, category, count(*) AS n, count(DISTINCT doc_id) AS documents FROM spans GROUP BY source, category",
    "custom_pattern": spans_sql([Pattern("SECRET_TOKEN", r'token = "[0-9a-f]{40}"')]) + ' SELECT doc_id, "start", "end", category FROM spans',
    "analyze": _plain + " SELECT d.doc_id, CAST(count(s.doc_id) AS INT) AS entity_count, coalesce(string_agg(category || ':' || \"start\" || ':' || \"end\" || ':[redacted]', ',' ORDER BY \"start\"), '') AS entities FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id",
    "redact_documents": _redacted + " SELECT m.doc_id, sha256(masked) AS masked_sha256, CAST(length(masked) AS INT) AS n_chars, CAST((SELECT count(*) FROM spans s WHERE s.doc_id = m.doc_id) AS INT) AS entity_count FROM masked m",
    "session_tokens": _session + " SELECT source, key, category, token FROM tokens",
    "guard_sanitize": f"""{_tokenized} SELECT {_of_text}, 'sanitize' AS event_type, count(p."start") AS entity_count, {_hash.format('d.text')} AS prompt_hash,
  {_hash.format('m.masked')} AS sanitized_hash {_meet}""",
    "guard_desanitize": f"""{_tokenized} SELECT {_of_text}, concat('d', m.doc_id) AS decision_id, count(DISTINCT p.token) AS entity_count, {_hash.format('m.masked')} AS prompt_hash,
  true AS hides, sha256(d.text) AS restored_sha256 {_meet}""",
    "tokenize_documents": _tokenized + " SELECT doc_id, sha256(masked) AS masked_sha256, CAST(length(masked) AS INT) AS n_chars FROM masked",
    "restore_roundtrip": _tokenized + " SELECT d.lang, count(*) AS documents, count(*) AS same, CAST(count(*) FILTER (m.masked <> d.text) AS BIGINT) AS masked FROM documents d JOIN masked m ON d.doc_id = m.doc_id GROUP BY d.lang",
    "present_tokens": _tokenized + ", held AS (SELECT DISTINCT doc_id, token FROM pieces) SELECT doc_id, string_agg(token, ',' ORDER BY token) AS tokens FROM held GROUP BY doc_id",
    "entity_details": _plain + f' SELECT doc_id, category, "start", "end", "end" - "start" AS length, 0.95::DOUBLE AS confidence, \'regex\' AS source, {_hash_sql("category", "text")} AS entity_hash FROM spans',
    "entity_hash_linkage": _plain + f" SELECT category, {_hash_sql('category', 'any_value(text)')} AS entity_hash, count(DISTINCT doc_id) AS documents, count(*) AS mentions FROM spans GROUP BY category, lower(text) HAVING count(DISTINCT doc_id) > 1",
    "token_summary": _session + " SELECT source, category, count(*) AS n, CAST(max(length(token)) AS INT) AS longest, count(*) FILTER (length(token) <= 40) AS valid FROM tokens GROUP BY source, category",
    "token_grammar": r"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda x: upper(x)))) AS w FROM documents),
t AS (SELECT CASE doc_id % 3 WHEN 0 THEN '[' || w || '_' || doc_id || ']' WHEN 1 THEN '[' || w || '_REDACTED]' ELSE '[' || lower(w) || '_1]' END AS t FROM w),
p AS (SELECT t, regexp_matches(t, '^\[([A-Z][A-Z0-9_]*)_([0-9]+|REDACTED)\]$') AS ok FROM t)
SELECT ok AND length(t) <= 40 AS valid, ok AND ends_with(t, '_REDACTED]') AS is_redacted, CASE WHEN ok THEN regexp_extract(t, '_([0-9]+|REDACTED)\]$', 1) END AS suffix, count(*) AS n,
  max(CASE WHEN ok THEN regexp_extract(t, '^\[([A-Z][A-Z0-9_]*)_', 1) END) AS last_category FROM p GROUP BY 1, 2, 3""",
    "escape_lookalikes": rf"""WITH t AS (SELECT doc_id, '[EMAIL_0] ' || coalesce(text, '') || ' [A_B2_REDACTED] [a_1]' AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(t, '{T.TOKEN}', '［\1］', 'g')) AS escaped_sha256, CAST(length(t) AS INT) AS n_chars, sha256(t) AS back_sha256 FROM t""",
    "context_risk": _risk,
    "locale_values": _values,
    "masked_conversations": _conv,
    "masked_odd_conversations": _odd,
    "skip_models": "SELECT starts_with(source || '/model', 'src1') OR starts_with(source || '/model', 'local/') AS skipped, count(*) AS n FROM documents GROUP BY 1",
    "category_registry": "SELECT * FROM (VALUES " + ", ".join(f"({q(c)}, {q(f)})" for c, f in registry()) + ") v(category, family)",
    "prompt_hashes": "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE sha256(text) END AS prompt_hash FROM documents",
} | {f"locale_{name}": spans_sql([*ps, _email]) + ' SELECT doc_id, "start", "end", category, text FROM spans' for name, ps in LOCALES.items()}
