"""Queries of audit records, reports, attestation, evaluation and streams, with their SQL.

The driver's tables hold no audit records; a view of such records is made of `events`, by the same expressions in Spark and DuckDB.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.config import Detect
from veilwork.functions.ed25519 import b64, key_id, public_of, signed
from veilwork.functions.shared import removed, shared_folder, spread
from veilwork.functions.vault import passing, sealed, vault
from veilwork.operators import attest as AT
from veilwork.operators import audit as A
from veilwork.operators import blocktree as B
from veilwork.operators import evaluate as E
from veilwork.operators import masking as M
from veilwork.operators import report as R
from veilwork.operators.provenance import provenance
from veilwork.operators.schema_columns import faults
from veilwork.plans import detection
from veilwork.plans.detection import tokenized_sql
from veilwork.plans.sql import spans_sql
from veilwork.sources.audit_log import RANGES, read_lines
from veilwork.streaming.restore import restored_stream
from veilwork.streaming.sessions import masked_stream
from veilwork.streaming.shards import ShardedLog
from veilwork.streaming.state import drain

#: Columns of the view in the language that Spark and DuckDB share; {ts} is the time as text.
COMMON = {
    "seq": "event_id",
    "timestamp": "{ts}",
    "event_type": """CASE event_id % 12 WHEN 5 THEN 'desanitize' WHEN 6 THEN 'bias_session_start' WHEN 7 THEN 'bias_session_end' WHEN 8 THEN 'bias_finding'
      WHEN 9 THEN 'content_generation' WHEN 10 THEN 'content_generation' ELSE 'sanitize' END""",
    "model": "concat('m', CAST(user_id % 3 AS {text}))",
    "entity_count": "CAST(event_id % 4 AS INT)",
    "latency_ms": "value",
    "decision_id": "CASE WHEN event_id % 5 = 0 THEN concat('d', CAST(user_id AS {text})) END",
    "certificate_hash": "CASE WHEN event_id % 3 = 0 THEN concat('c', CAST(event_id AS {text})) END",
    "key_id": "CASE WHEN event_id % 3 = 0 THEN concat('k', CAST(user_id % 7 AS {text})) END",
    "pii_in_log": "event_id % 997 = 3",
    "email_n": "CAST(event_id % 3 AS DOUBLE)",
    "phone_n": "CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE CAST(user_id % 2 AS DOUBLE) END",
    "wiped": "event_id % 24 = 7",
    "modality": "CASE WHEN event_id % 24 < 12 THEN 'text' ELSE 'image' END",
    "synthetic": "event_id % 36 <> 9",
    "labeled": "event_id % 48 <> 10",
    "deepfake": "event_id % 60 = 9",
}
KEYS = [(f"k{i}", f"2024-01-{5 + 3 * i:02d}T00:00:00Z", None if i == 6 else f"2024-01-{12 + 2 * i:02d}T00:00:00Z") for i in range(7)]
REVOKED = [("k1", "2024-01-11T00:00:00"), ("k1", "2024-01-20T00:00:00"), ("k4", "2024-01-18T12:00:00"), ("k9", "2024-01-01T00:00:00")]
START, END = "2024-01-03T00:00:00", "2024-01-27T23:59:59"


def view(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    e = e.selectExpr("*", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS tt")
    v = e.selectExpr(*[f"{x.format(ts='tt', text='STRING')} AS {c}" for c, x in COMMON.items()])
    kind = F.col("event_type")
    art = F.array(F.lit("EU_AI_Act_Art_12"), F.lit("EU_AI_Act_Art_19"))
    refs = F.when(kind.startswith("bias_"), F.concat(art, F.array(F.lit(R.ART_4A)))).when(kind == "content_generation", F.concat(art, F.array(F.lit(R.ART_50)))).otherwise(art)
    return v.select(
        "*", F.create_map(F.lit("EMAIL"), "email_n", F.lit("PHONE"), "phone_n").alias("categories"), refs.alias("article_ref"),
        F.when(kind == "bias_session_end", F.struct(F.col("wiped").alias("wipe_confirmed"))).alias("bias_context"),
        F.when(kind == "content_generation", F.struct("modality", "synthetic", "labeled", "deepfake")).alias("content_context"),
        F.substring("timestamp", 1, 10).alias("file"), F.col("seq").alias("line_no"),
    )


def _view_sql() -> str:
    cols = ", ".join(f'{x.format(ts="strftime(ts, " + chr(39) + "%Y-%m-%dT%H:%M:%S" + chr(39) + ")", text="VARCHAR")} AS "{c}"' for c, x in COMMON.items())
    return f"""WITH v AS (SELECT {cols} FROM events),
a AS (SELECT *, list_concat(['EU_AI_Act_Art_12', 'EU_AI_Act_Art_19'], CASE WHEN starts_with(event_type, 'bias_') THEN ['{R.ART_4A}'] WHEN event_type = 'content_generation' THEN ['{R.ART_50}'] ELSE [] END) AS article_ref FROM v),
p AS (SELECT * FROM a WHERE "timestamp" >= '{START}' AND "timestamp" <= '{END}')"""


VIEW = _view_sql()
_pct = "CASE WHEN {d} = 0 THEN 0.0::DOUBLE ELSE ((10000 * ({n}) + ({d}) // 2) // ({d})) / 100.0::DOUBLE END"


def period(spark: SparkSession, sf: str) -> DataFrame:
    return R.in_period(view(spark, sf), START, END)


def per_article(spark: SparkSession, sf: str) -> DataFrame:
    r = R.by_article(period(spark, sf))
    return r.withColumns({"wipe_confirmed_pct": R.pct(F.col("bias_wiped"), F.col("bias_ends")), "label_coverage_pct": R.pct(F.col("labeled_events"), F.col("generation_events"))})


def article_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Of records that touch Article 4a or 50 all their articles."""
    return R.by_article(R.touching(period(spark, sf), [R.ART_4A, R.ART_50])).select("article", "evidence_event_count", "decision_count")


def article_categories(spark: SparkSession, sf: str) -> DataFrame:
    return R.article_categories(period(spark, sf))


def per_decision(spark: SparkSession, sf: str) -> DataFrame:
    return R.by_decision(period(spark, sf))


def content_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return R.modalities(period(spark, sf))


def unlabeled_content(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf).filter("event_type = 'content_generation' and content_context.synthetic and not content_context.labeled")
    return v.select("seq", "timestamp")


def pii_violations(spark: SparkSession, sf: str) -> DataFrame:
    return period(spark, sf).filter("pii_in_log").select("seq", "timestamp")


def audit_stats(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf)
    return v.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("entity_count").cast("long").alias("entities"), F.countDistinct("model").alias("models"))


def category_sums(spark: SparkSession, sf: str) -> DataFrame:
    return A.category_sums(view(spark, sf))


def metrics_rollup(spark: SparkSession, sf: str) -> DataFrame:
    m = A.metrics(view(spark, sf))
    return m.select("event_type", "calls", F.round("total_ms", 2).alias("total_ms"), F.round("avg_ms", 4).alias("avg_ms"), F.col("entities").cast("long").alias("entities"))


def latency_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf).groupBy(A.latency_bucket(F.col("latency_ms")).alias("bucket")).agg(F.count("*").alias("n"))


def validity_window(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark.createDataFrame(KEYS, "key_id string, b string, e string").select("key_id", F.to_timestamp("b").alias("begins"), F.to_timestamp("e").alias("ends"))
    w = R.in_window(period(spark, sf), keys, skew_s=0)
    return w.groupBy("key_id").agg(F.count("*").alias("certified"), F.count_if("within").alias("within"))


def revocation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    revoked = spark.createDataFrame(REVOKED, "key_id string, revoked_at string")
    u = R.revoked_uses(period(spark, sf), revoked)
    return u.groupBy("key_id").agg(F.count("*").alias("certified"), F.count_if("after").alias("after_revocation"))


def chain_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a chain in which each record's stored hash is that of its text, the one before is claimed, and some claims are wrong."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("file"), F.col("event_id").alias("line_no"), F.sha2(F.concat_ws("|", "event_id", "event_type", "props"), 256).alias("stored"))
    linked = A.linked(e)
    claimed = F.when(F.col("line_no") % 101 == 7, F.sha2("expected", 256)).otherwise(F.col("expected"))
    return linked.select("file", "line_no", "expected", (claimed != F.col("expected")).alias("broken"))


def chain_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Records chained per day, read as lines and verified: what is found wrong (nothing), and what with every 500th line changed."""
    v = view(spark, sf)
    entries = v.select("file", "seq", F.to_json(F.struct("event_type", "timestamp", "model", "entity_count", "latency_ms", "decision_id")).alias("entry"))
    lines = A.chained(entries, chain="file").select("file", (F.col("seq") + 1).cast("int").alias("line_no"), F.col("entry").alias("line"))
    torn = F.when(F.col("line_no") % 500 == 3, F.regexp_replace("line", '"model": "m', '"model": "x')).otherwise(F.col("line"))
    # Both logs in one pass, told apart by `part`: a chain is serial work and is made once.
    both = lines.select("file", "line_no", F.posexplode(F.array("line", torn)).alias("part", "line"))
    said = lambda k: [F.count_if(F.col("part") == k), F.count_if((F.col("part") == k) & (F.col("stored") == F.col("computed")))]
    whole = A.hashed(both).agg(*[c.alias(f"{n}{k}") for k in (0, 1) for n, c in zip("ri", said(k), strict=True)])
    logs = [F.struct(F.col(f"r{k}").alias("records"), F.col(f"i{k}").alias("intact"), F.lit(name).alias("log")) for k, name in enumerate(("as written", "changed"))]
    return whole.select(F.explode(F.array(*logs)).alias("l")).select("l.*")


SHARDS = 16


def sharded_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Records of events appended by a stream to a log of 16 chains, in three batches of which the first comes twice: each chain's end and faults."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    entry = F.to_json(F.struct("event_type", F.struct(F.col("event_id").alias("event"), F.col("user_id").alias("user")).alias("metadata")))
    entries = e.select(F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("order"), entry.alias("entry"))
    path, folder = passing(spark, "shards"), f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    try:
        log = ShardedLog(spark, f"{folder}/log", SHARDS)
        for k in range(3):
            entries.filter(F.col("order") % 3 == k).write.mode("append").parquet(f"{folder}/in")
            log.stream(spark.readStream.schema(entries.schema).parquet(f"{folder}/in"), f"{folder}/progress").awaitTermination()
            log.append(entries.filter(F.col("order") % 3 == 0), 0)  # was committed: adds nothing
        wrong = log.faults().groupBy("shard").agg(F.count("*").alias("n"))
        heads = log.heads().join(wrong, "shard", "left")
        heads.select("shard", F.col("next").alias("records"), "head", F.coalesce("n", F.lit(0)).cast("long").alias("faults")).write.parquet(path)
    finally:
        removed(spark, folder)
    return spark.read.parquet(path)


#: What every 13th record gets beyond its fields, and what is found in it. Each is a field of JSON text.
PLANTED = {
    1: ('"odd":1', "odd: unknown field"),
    2: ('"decision_id":"a b"', "decision_id: not 1 to 64 printable characters"),
    3: ('"metadata":{"a":{"b":{"c":{"d":1}}}}', "metadata.a.b.c.d: nested too deeply"),
    4: ('"entity_details":[{"start":1},{"value":"x"}]', "entity_details[1].value: a value of the text"),
    5: ('"content_context":{"modality":"text","synthetic":true,"labeled":1,"disclosure_method":"none","deepfake":false}', "content_context.labeled: bad value"),
    6: ('"content_context":{"modality":"text","synthetic":true,"labeled":true,"disclosure_method":"none","body":"x"}', "content_context.body: content itself;content_context.deepfake: missing"),
    7: ('"bias_context":{"session_id":null}', "bias_context.session_id: null;bias_context: not in a record of type content_generation"),
    8: ('"checkpoint_context":[]', "checkpoint_context: no object"),
}


def schema_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Records of events with planted faults, checked by columns: what is found in each, joined in order."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("event_id") % 13).alias("k"))
    more = F.coalesce(F.get(F.array(*[F.lit("," + PLANTED[k][0] if k in PLANTED else "") for k in range(13)]), F.col("k").cast("int")), F.lit(""))
    line = F.concat(F.lit('{"seq":'), F.col("event_id").cast("string"), F.lit(',"event_type":"content_generation"'), more, F.lit("}"))
    found = e.select("event_id", line.alias("line")).select("event_id", faults(F.col("line")).alias("found"))
    return found.select("event_id", F.array_join(F.array_sort("found"), ";").alias("violations"))


def log_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as lines of JSON in order of their ids, read back by byte ranges: each one's number in the whole, and its text's digest."""
    path, folder = passing(spark, "ranges"), f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    try:
        docs.orderBy("doc_id").select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(f"{folder}/log")
        lines = read_lines(spark, f"{folder}/log", "part-*")
        sizes = lines.groupBy("file").agg(F.max("line_no").alias("n"))  # a row for each file
        before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        got = lines.join(F.broadcast(before) if len(docs.sparkSession.read.text(f"{folder}/log").inputFiles()) <= RANGES else before, "file").select((F.col("before") + F.col("line_no")).alias("line_no"), F.from_json("line", "doc_id long, text string").alias("r"))
        got.select("line_no", "r.doc_id", F.sha2("r.text", 256).alias("text_sha256")).write.parquet(path)
    finally:
        removed(spark, folder)
    return spark.read.parquet(path)


def _tree(spark: SparkSession, sf: str) -> B.Tree:
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return B.built(docs, "doc_id", "h", passing(spark, "tree"))


def merkle_root(spark: SparkSession, sf: str) -> DataFrame:
    tree = _tree(spark, sf)
    return spark.createDataFrame([(tree.root(), tree.levels())] if tree.leaves else [], "root string, levels long")


def merkle_proofs(spark: SparkSession, sf: str) -> DataFrame:
    """The root that each document's proof leads to: one root for all."""
    return _tree(spark, sf).proofs().groupBy(AT.proven_root(F.col("hash"), F.col("proof")).alias("root")).agg(F.count("*").alias("leaves"))


#: Keys of certificates made for documents: (seed, begin and end of each time in use); the last key has no manifest, and one is revoked.
ISSUERS = (("k0", (("2025-01-01", None),)), ("k1", (("2025-01-01", "2025-01-20"), ("2025-02-01", None))), ("k2", (("2025-01-01", "2025-02-15"),)), ("k3", ()))
GONE = "2025-01-25"


def provenance_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A certificate for each document, some of them changed afterwards, against the manifests of their keys and a revocation list."""
    seeds = [hashlib.sha256(seed.encode()).digest() for seed, _ in ISSUERS]
    publics = [public_of(s) for s in seeds]
    day = lambda d: None if d is None else f"{d}T00:00:00Z"
    manifests = [AT.derive_manifest(p, "d", day(b), day(e)) for p, (_, spans) in zip(publics, ISSUERS, strict=True) for b, e in spans]
    revocations = AT.derive_revocations("d", [{"key_id": key_id(publics[2]), "revoked_at": day(GONE), "reason": "lost"}], day(GONE))

    @F.pandas_udf("string")
    def issued(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        out = []
        for i, h in zip(ids, hashes, strict=True):
            at = datetime(2025, 1, 1, tzinfo=UTC) + timedelta(hours=int(i) % 2000)
            c = {"version": "1.0", "timestamp": at.isoformat(), "input_hash": h, "output_hash": h, "entity_count": 0, "categories": {}, "detection_passes": ["regex"], "mode": "tokenize", "key_id": key_id(publics[i % 4]), "nonce": str(i)}
            c |= {"signature": b64(signed(seeds[i % 4], AT.signed_part(c))), "public_key": b64(publics[i % 4])}
            out.append(json.dumps(c | {"entity_count": 1} if i % 7 == 3 else c))
        return pd.Series(out, dtype=object)

    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"))
    certificates = docs.select("doc_id", issued(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("certificate"))
    out = provenance(certificates, spark.createDataFrame([(json.dumps(m),) for m in manifests], "manifest string"), revocations)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return out.select("doc_id", "manifest_found", said("signature_valid"), said("within_validity_window"), "revocation_status", said("overall_valid"))


#: Labels for evaluation: a plain rule of our own for addresses and for 16 digits, against the patterns.
LABELS = (("EMAIL", r"[a-z0-9.]+@[a-z.]+"), ("CREDIT_CARD", r"\b[0-9]{16}\b"))
FOUND = Detect(max_chars=0, only=("EMAIL",), custom=(("CARDISH", r"\b4\d{15}\b"),))


def _labels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from veilwork.functions.patterns import Pattern
    from veilwork.functions.spans import claimed, matches

    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"))
    marked = docs.withColumn("labels", claimed(*[matches(F.col("text"), Pattern(c, p)) for c, p in LABELS]))
    found = M.detected(marked, FOUND)
    card = lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), F.when(d["category"] == "CARDISH", "CREDIT_CARD").otherwise(d["category"]).alias("category"))
    both = found.select("doc_id", F.transform("spans", card).alias("found"), F.transform("labels", card).alias("labels"))
    return both, both.filter("size(found) > 0 or size(labels) > 0")


def eval_prf(spark: SparkSession, sf: str) -> DataFrame:
    _, some = _labels(spark, sf)
    return E.scores(E.matched(some.withColumnRenamed("doc_id", "sample")), "category")


def eval_coverage(spark: SparkSession, sf: str) -> DataFrame:
    both, _ = _labels(spark, sf)
    flat = lambda c: both.select("doc_id", F.explode(c).alias("d")).select("doc_id", "d.*")
    c = E.coverage(flat("labels"), flat("found"))
    return c.groupBy("category", "state").agg(F.count("*").alias("n"), F.count_if("right_category").alias("right_category"), F.round(F.sum("share"), 4).alias("share"))


def native_vs_reference_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in which the column engine and a sequential scan in Python differ: none."""
    from veilwork.sources.backends import PatternBackend, with_backends

    docs = spread(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text")
    native = M.entities(M.detected(docs, Detect(max_chars=0)), "doc_id").select("doc_id", "start", "end", "category")
    scanned = M.entities(with_backends(docs, [PatternBackend(Detect(max_chars=0))]), "doc_id").select("doc_id", "start", "end", "category")
    return E.differences(native, scanned)


STREAMED = Detect(max_chars=0, only=("EMAIL",), custom=(("CARD_DIGITS", r"\b[3-6]\d{15}\b"),))


def _streamed(chunks: DataFrame, later: Column, change: Callable[[DataFrame], DataFrame], what: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """what(change(stream)) of rows that come in two parts, the second once the first has been taken; the stream's folder is gone then."""
    spark = chunks.sparkSession
    path, folder = passing(spark, "streamed"), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    try:
        rows = vault(spark).keep(chunks.withColumn("later", later))
        for part in (~F.col("later"), F.col("later")):
            rows.filter(part).drop("later").write.mode("append").parquet(f"{folder}/in")
            out = drain(change(spark.readStream.schema(chunks.schema).parquet(f"{folder}/in")), folder)
        what(out).write.parquet(path)
    finally:
        removed(spark, folder)
    return spark.read.parquet(path)


@sealed
def stream_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Masked texts cut to chunks, restored by the stateful stream and joined again. Second halves come later, and of some streams a chunk of the first half too."""
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet")).select(F.col("doc_id").alias("stream_id"), "source", "text").filter("text is not null")
    values = M.met(M.detected(docs, STREAMED), "source", "stream_id")
    tokens = M.session_tokens(values, "source", "stream_id")
    masked = M.tokenized(docs, values, tokens, "source")
    held = M.held_values(masked, tokens, "source")  # the tokens that a stream holds, no others
    rows = M.brought(masked, held, "source", "masked", "values", False).withColumn("cuts", F.regexp_extract_all("masked", F.lit(r"(?s).{1,37}"), F.lit(0)))
    rows = rows.withColumn("cuts", F.when(F.size("cuts") == 0, F.array(F.lit(""))).otherwise(F.col("cuts")))
    rows = rows.select("stream_id", F.size("cuts").alias("n"), F.posexplode("cuts").alias("seq", "chunk"), F.col("__what").alias("tokens"))
    chunks = rows.select("stream_id", F.col("seq").cast("long"), "chunk", (F.col("seq") == F.col("n") - 1).alias("last"), F.when(F.col("seq") == 0, F.col("tokens")).alias("tokens"), "n")

    def joined(out: DataFrame) -> DataFrame:
        chunk = F.struct("is_summary", "seq", "chunk", "chars_processed", "stream_error")
        whole = out.groupBy("stream_id").agg(F.sort_array(F.collect_list(chunk)).alias("c"))  # a stream's own chunks, as long as its text
        ends = F.filter("c", lambda c: c["is_summary"])
        text = F.array_join(F.transform("c", lambda c: c["chunk"]), "")
        return whole.select("stream_id", F.sha2(text, 256).alias("restored_sha256"), F.size(ends).cast("long").alias("summaries"), F.get(ends, F.lit(0))["chars_processed"].alias("chars"), F.get(ends, F.lit(0))["stream_error"].alias("stream_error"))

    later = (F.col("seq") * 2 >= F.col("n")) | ((F.col("stream_id") % 10 == 0) & (F.col("seq") == 1))
    return _streamed(chunks, later, restored_stream, joined)


@sealed
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations masked as they come, first every other turn, then those between; with the tokens that the batch gives."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    mail = F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), F.concat("text", F.lit(" user"), F.col("conv_id"), F.lit("@example.com"))).otherwise(F.col("text"))
    ends = rows.groupBy("conv_id").agg(F.max("turn").alias("end"))
    turns = rows.withColumn("text", mail).join(ends, "conv_id").withColumn("last", F.col("turn") == F.col("end")).drop("end")
    done = lambda out: out.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.sha2("masked", 256).alias("text_sha256"))
    return _streamed(turns, F.col("turn") % 2 == 0, lambda stream: masked_stream(stream, Detect(only=("EMAIL",), max_chars=0), secret=sf), done)


QUERIES = {
    "per_article": per_article, "article_scope": article_scope, "article_categories": article_categories, "per_decision": per_decision,
    "content_coverage": content_coverage, "unlabeled_content": unlabeled_content, "pii_violations": pii_violations, "audit_stats": audit_stats,
    "category_sums": category_sums, "metrics_rollup": metrics_rollup, "latency_bucket": latency_bucket, "validity_window": validity_window,
    "revocation_rollup": revocation_rollup, "verify_chain_links": chain_links, "chain_roundtrip": chain_roundtrip, "merkle_root": merkle_root,
    "merkle_proofs": merkle_proofs, "provenance_checks": provenance_checks, "eval_prf": eval_prf, "eval_coverage": eval_coverage, "native_vs_reference_scan": native_vs_reference_scan,
    "stream_restore": stream_restore, "stream_sessions": stream_sessions, "sharded_chain": sharded_chain, "log_ranges": log_ranges, "schema_columns": schema_columns,
}

_keys = ", ".join(f"('{k}', TIMESTAMP '{b[:-1].replace('T', ' ')}', {'NULL' if e is None else 'TIMESTAMP ' + chr(39) + e[:-1].replace('T', ' ') + chr(39)})" for k, b, e in KEYS)
_revoked = ", ".join(f"('{k}', '{t}')" for k, t in REVOKED)
_each = f"{VIEW}, e AS (SELECT *, unnest(article_ref) AS article FROM p)"
_sums = "UNION ALL".join(f" SELECT {{k}}, '{c}' AS category, {n} AS n FROM {{v}} WHERE {n} = floor({n}) " for c, n in (("EMAIL", "email_n"), ("PHONE", "phone_n")))
_levels = """WITH RECURSIVE leaves AS (SELECT row_number() OVER (ORDER BY doc_id, h) - 1 AS idx, h FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)),
up AS (SELECT 1 AS level, idx, h, (SELECT count(*) FROM leaves) AS n FROM leaves
UNION ALL SELECT level + 1, idx // 2, CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(max(h) FILTER (idx % 2 = 0) || max(h) FILTER (idx % 2 = 1)) END, (n + 1) // 2 FROM up WHERE n > 1 GROUP BY level, idx // 2, n)"""
_issuers = ", ".join(f"({k}, TIMESTAMP '{b}', {'NULL' if e is None else f"TIMESTAMP '{e}'"})" for k, (_, spans) in enumerate(ISSUERS) for b, e in spans)
_provenance = f"""WITH c AS (SELECT doc_id, doc_id % 4 AS k, TIMESTAMP '2025-01-01' + to_hours(CAST(doc_id % 2000 AS INT)) AS t, doc_id % 7 <> 3 AS good FROM documents),
m(k, b, e) AS (VALUES {_issuers}),
w AS (SELECT c.doc_id, count(m.k) > 0 AS manifest_found, coalesce(bool_or(t >= b - INTERVAL 5 MINUTE AND (e IS NULL OR t <= e + INTERVAL 5 MINUTE)), false) AS held FROM c LEFT JOIN m ON c.k = m.k GROUP BY c.doc_id)
SELECT doc_id, manifest_found, CASE WHEN manifest_found THEN CAST(good AS VARCHAR) ELSE 'unknown' END AS signature_valid, CASE WHEN manifest_found THEN CAST(held AS VARCHAR) ELSE 'unknown' END AS within_validity_window,
  CASE WHEN k <> 2 THEN 'NOT_REVOKED' WHEN t < TIMESTAMP '{GONE}' THEN 'PREDATES_REVOCATION' ELSE 'REVOKED' END AS revocation_status,
  CASE WHEN manifest_found THEN CAST(good AND held AND NOT (k = 2 AND t >= TIMESTAMP '{GONE}') AS VARCHAR) ELSE 'unknown' END AS overall_valid FROM c JOIN w USING (doc_id)"""
_made = "event_type = 'content_generation' AND synthetic"
_eval_found = spans_sql(FOUND.patterns())
_eval_labels = spans_sql([type(FOUND.patterns()[0])(c, p) for c, p in LABELS])
_eval = f"""WITH found AS ({_eval_found} SELECT doc_id, "start", "end", CASE category WHEN 'CARDISH' THEN 'CREDIT_CARD' ELSE category END AS category FROM spans),
labels AS ({_eval_labels} SELECT doc_id, "start", "end", category FROM spans)"""

SQL = {
    "per_article": f"""{_each}, c AS (SELECT article, count(*) AS evidence_event_count, count(DISTINCT decision_id) AS decision_count, bool_or(pii_in_log) AS pii_in_log,
  count(*) FILTER (event_type = 'bias_session_start') AS bias_sessions, count(*) FILTER (event_type = 'bias_finding') AS findings_recorded,
  count(*) FILTER (event_type = 'bias_session_end') AS bias_ends, count(*) FILTER (event_type = 'bias_session_end' AND wiped) AS bias_wiped,
  count(*) FILTER ({_made}) AS generation_events, count(*) FILTER ({_made} AND labeled) AS labeled_events, count(*) FILTER ({_made} AND deepfake) AS deepfake_events FROM e GROUP BY article)
SELECT *, {_pct.format(n="bias_wiped", d="bias_ends")} AS wipe_confirmed_pct, {_pct.format(n="labeled_events", d="generation_events")} AS label_coverage_pct FROM c""",
    "article_scope": f"{_each} SELECT article, count(*) AS evidence_event_count, count(DISTINCT decision_id) AS decision_count FROM e WHERE len(article_ref) = 3 GROUP BY article",
    "article_categories": f"{_each} SELECT article, category, CAST(sum(n) AS BIGINT) AS n FROM ({_sums.format(k='article', v='e')}) GROUP BY article, category",
    "per_decision": f"""{VIEW}, s AS (SELECT decision_id, category, CAST(sum(n) AS BIGINT) AS n FROM ({_sums.format(k='decision_id', v='p')}) GROUP BY ALL),
sj AS (SELECT decision_id, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM s GROUP BY decision_id),
d AS (SELECT decision_id, count(*) AS entry_count, min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp, array_to_string(list_sort(list_distinct(flatten(list(article_ref)))), ',') AS articles_touched FROM p WHERE decision_id IS NOT NULL GROUP BY decision_id)
SELECT d.*, coalesce(categories, '') AS categories FROM d LEFT JOIN sj USING (decision_id)""",
    "content_coverage": f"{VIEW} SELECT modality, count(*) AS n FROM p WHERE {_made} GROUP BY modality",
    "unlabeled_content": f'{VIEW} SELECT seq, "timestamp" FROM v WHERE {_made} AND NOT labeled',
    "pii_violations": f'{VIEW} SELECT seq, "timestamp" FROM p WHERE pii_in_log',
    "audit_stats": f"{VIEW} SELECT event_type, count(*) AS events, CAST(sum(entity_count) AS BIGINT) AS entities, count(DISTINCT model) AS models FROM v GROUP BY event_type",
    "category_sums": f"{VIEW} SELECT category, CAST(sum(n) AS BIGINT) AS n FROM ({_sums.format(k='seq', v='v')}) GROUP BY category",
    "metrics_rollup": f"{VIEW} SELECT event_type, count(*) AS calls, round(sum(latency_ms), 2) AS total_ms, round(avg(latency_ms), 4) AS avg_ms, CAST(sum(entity_count) AS BIGINT) AS entities FROM v GROUP BY event_type",
    "latency_bucket": f"{VIEW} SELECT round_even(latency_ms / 10, 0) * 10 AS bucket, count(*) AS n FROM v GROUP BY 1",
    "validity_window": f"""{VIEW}, k(key_id, b, f) AS (VALUES {_keys}) SELECT p.key_id, count(*) AS certified,
  count(*) FILTER (CAST("timestamp" AS TIMESTAMP) >= b AND (f IS NULL OR CAST("timestamp" AS TIMESTAMP) <= f)) AS within FROM p JOIN k ON p.key_id = k.key_id WHERE certificate_hash IS NOT NULL GROUP BY p.key_id""",
    "revocation_rollup": f"""{VIEW}, r AS (SELECT key_id, min(t) AS t FROM (VALUES {_revoked}) x(key_id, t) GROUP BY key_id)
SELECT p.key_id, count(*) AS certified, count(*) FILTER ("timestamp" >= t) AS after_revocation FROM p JOIN r ON p.key_id = r.key_id WHERE certificate_hash IS NOT NULL GROUP BY p.key_id""",
    "verify_chain_links": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS file, event_id AS line_no, sha256(concat_ws('|', event_id, event_type, props)) AS stored FROM events)
SELECT file, line_no, coalesce(lag(stored) OVER (ORDER BY file, line_no), repeat('0', 64)) AS expected, line_no % 101 = 7 AS broken FROM e""",
    "sharded_chain": f"""WITH RECURSIVE e AS (SELECT CAST(('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % {SHARDS} AS INT) AS shard, event_id,
  '{{"event_type":"' || event_type || '","metadata":{{"event":' || event_id || ',"user":' || user_id || '}},"prev_hash":"' AS entry FROM events),
n AS (SELECT shard, entry, row_number() OVER (PARTITION BY shard ORDER BY event_id % 3, event_id) - 1 AS seq FROM e),
c AS (SELECT shard, seq, sha256(entry || repeat('0', 64) || '","seq":0}}') AS head FROM n WHERE seq = 0
  UNION ALL SELECT n.shard, n.seq, sha256(n.entry || c.head || '","seq":' || n.seq || '}}') FROM c JOIN n ON n.shard = c.shard AND n.seq = c.seq + 1)
SELECT shard, count(*) AS records, arg_max(head, seq) AS head, 0::BIGINT AS faults FROM c GROUP BY shard""",
    "schema_columns": f"SELECT event_id, CASE event_id % 13 {' '.join(f'WHEN {k} THEN {chr(39)}{said}{chr(39)}' for k, (_, said) in PLANTED.items())} ELSE '' END AS violations FROM events",
    "log_ranges": "SELECT row_number() OVER (ORDER BY doc_id) AS line_no, doc_id, sha256(text) AS text_sha256 FROM documents",
    "provenance_checks": _provenance,
    "merkle_root": f"{_levels} SELECT h AS root, CAST(level AS BIGINT) AS levels FROM up WHERE n = 1",
    "merkle_proofs": f"{_levels} SELECT h AS root, (SELECT count(*) FROM leaves) AS leaves FROM up WHERE n = 1",
    "eval_coverage": f"""{_eval},
c AS (SELECT l.doc_id, l."start" AS s, l."end" AS e, l.category, unnest(range(l."start", l."end")) AS ch FROM labels l),
h AS (SELECT c.doc_id, c.s, c.e, c.category, count(*) FILTER (EXISTS (SELECT 1 FROM found f WHERE f.doc_id = c.doc_id AND c.ch >= f."start" AND c.ch < f."end")) / count(*) AS share,
  bool_or(EXISTS (SELECT 1 FROM found f WHERE f.doc_id = c.doc_id AND f.category = c.category AND c.ch >= f."start" AND c.ch < f."end")) AS ok FROM c GROUP BY ALL)
SELECT category, CASE WHEN share >= 0.99 THEN 'scrubbed' WHEN share > 0 THEN 'partial' ELSE 'raw' END AS state, count(*) AS n, count(*) FILTER (ok) AS right_category, round(sum(share), 4) AS share FROM h GROUP BY 1, 2""",
    "chain_roundtrip": """WITH n AS (SELECT row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS k FROM events)
SELECT 'as written' AS log, count(*) AS records, count(*) AS intact FROM n UNION ALL SELECT 'changed', count(*), count(*) FILTER (k % 500 <> 3) FROM n""",
    "stream_restore": tokenized_sql(STREAMED.patterns()) + " SELECT m.doc_id AS stream_id, sha256(d.text) AS restored_sha256, 1::BIGINT AS summaries, CAST(length(masked) AS BIGINT) AS chars, false AS stream_error FROM masked m JOIN documents d ON d.doc_id = m.doc_id WHERE d.text IS NOT NULL",
    "stream_sessions": detection.SQL["masked_conversations"].split("UNION ALL SELECT DISTINCT conv_id, -1")[0],
    "native_vs_reference_scan": 'SELECT doc_id, 0 AS "start", 0 AS "end", text AS category, text AS side FROM documents WHERE false',
}
