"""Compliance reports: records of a period rolled up by article and decision, with what attests them.

Each rollup is a grouped aggregate over the records; only rows per article (or key, or checkpoint source) come to the driver.
Times are compared as the strings that they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.canonical import canonical, digest
from veilwork.operators.timestamps import inspect

# Names of articles and of the root signature's states.
ART_4A, ART_50 = "EU_AI_Act_Art_4a", "EU_AI_Act_Art_50"
ROOT_STATES = ("VALID", "INVALID", "NOT_REQUESTED", "UNVERIFIED_NO_KEY")
SCHEMA_VERSION = "1.0"
#: Which part of each article the records are evidence for, and what is left to whoever deploys the system.
COVERAGE = {
    "EU_AI_Act_Art_12": ("Record-keeping", "partial", "hash-chained records of each operation, without values", "log every interaction; check detection on own data; keep logs safe"),
    "EU_AI_Act_Art_19": ("Automatically generated logs", "partial", "the same records in a form that can be verified", "choose and keep the retention period"),
    ART_4A: ("Special-category data for bias detection", "partial", "sessions that pseudonymise declared spans and are wiped", "legal basis, scope and analysis"),
    ART_50: ("Transparency and content labelling", "record_keeping_only", "records of generated content by hash and of its disclosure", "label the content and tell its users"),
}
OUT_OF_SCOPE = ("risk management", "data governance", "transparency to deployers", "human oversight", "accuracy and security", "conformity assessment")


def pct(n: Column, d: Column) -> Column:
    """Percentage to two places, half up, in whole numbers; 0 of nothing is 0."""
    n, d = n.cast("long"), d.cast("long")
    return F.when(F.coalesce(d, F.lit(0)) == 0, 0.0).otherwise(F.floor((10000 * n + F.floor(d / 2)) / d) / 100)


def pct_of(n: int, d: int) -> int | float:
    """As pct(), whole numbers as int."""
    if not d:
        return 0
    hundredths = (10000 * n + d // 2) // d
    return hundredths // 100 if hundredths % 100 == 0 else hundredths / 100


def in_period(records: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bounds are inclusive; a record without a time is in no period."""
    out = records.filter("timestamp is not null and timestamp <> ''")
    if start:
        out = out.filter(F.col("timestamp") >= start)
    return out.filter(F.col("timestamp") <= end) if end else out


def touching(records: DataFrame, articles: list[str] | None) -> DataFrame:
    """Records with any of the articles."""
    return records.filter(F.arrays_overlap("article_ref", F.array(*map(F.lit, articles)))) if articles else records


def by_article(records: DataFrame) -> DataFrame:
    """A row per article: events, decisions, and the bias and content counts that only two articles are about."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = lambda k: F.col("event_type") == k
    made = kind("content_generation") & yes(F.col("content_context.synthetic"))
    each = records.withColumn("article", F.explode("article_ref"))
    return each.groupBy("article").agg(
        F.count("*").alias("evidence_event_count"),
        F.countDistinct("decision_id").alias("decision_count"),
        F.coalesce(F.bool_or("pii_in_log"), F.lit(False)).alias("pii_in_log"),
        F.count_if(kind("bias_session_start")).alias("bias_sessions"),
        F.count_if(kind("bias_finding")).alias("findings_recorded"),
        F.count_if(kind("bias_session_end")).alias("bias_ends"),
        F.count_if(kind("bias_session_end") & yes(F.col("bias_context.wipe_confirmed"))).alias("bias_wiped"),
        F.count_if(made).alias("generation_events"),
        F.count_if(made & yes(F.col("content_context.labeled"))).alias("labeled_events"),
        F.count_if(made & yes(F.col("content_context.deepfake"))).alias("deepfake_events"),
    )


def article_categories(records: DataFrame) -> DataFrame:
    """(article, category, n); counts that are not whole are left out."""
    each = records.select(F.explode("article_ref").alias("article"), "categories").select("article", F.explode("categories").alias("category", "n"))
    return each.filter("n = floor(n)").groupBy("article", "category").agg(F.sum("n").cast("long").alias("n"))


def modalities(records: DataFrame) -> DataFrame:
    """(modality, n) of synthetic content."""
    made = records.filter("event_type = 'content_generation' and content_context.synthetic and content_context.modality <> ''")
    return made.groupBy(F.col("content_context.modality").alias("modality")).agg(F.count("*").alias("n"))


def by_decision(records: DataFrame) -> DataFrame:
    """A row per decision: records, articles, first and last time, category sums as JSON."""
    some = records.filter("decision_id is not null and decision_id <> ''")
    sums = some.select("decision_id", F.explode("categories").alias("category", "n")).filter("n = floor(n)").groupBy("decision_id", "category").agg(F.sum("n").cast("long").alias("n"))
    sums = sums.groupBy("decision_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "category", "n"))), ",").alias("categories"))
    rows = some.groupBy("decision_id").agg(F.count("*").alias("entry_count"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("article_ref")))), ",").alias("articles_touched"))
    return rows.join(sums, "decision_id", "left").withColumn("categories", F.coalesce("categories", F.lit("")))


def manifests(records: DataFrame) -> DataFrame:
    """Registered keys: of each key the last manifest whose hash is new, and its times as timestamps."""
    m = records.filter("event_type = 'key_registered' and key_manifest.manifest_hash is not null").select("file", "line_no", "key_manifest.*")
    first = m.groupBy("manifest_hash").agg(F.min_by(F.struct("*"), F.struct("file", "line_no")).alias("m")).select("m.*")
    last = first.groupBy("key_id").agg(F.max_by(F.struct("*"), F.struct("file", "line_no")).alias("m")).select("m.*")
    return last.withColumns({"begins": F.try_to_timestamp("valid_from"), "ends": F.try_to_timestamp("valid_until")})


def in_window(records: DataFrame, keys: DataFrame, skew_s: int = 300) -> DataFrame:
    """Certified records of known keys with `within`: whether their time lies in the key's validity, give or take the skew.

    keys is a dimension of a few rows per key holder; Spark broadcasts it if its size allows.
    """
    some = records.filter("certificate_hash is not null and certificate_hash <> '' and event_type <> 'key_registered'").withColumn("at", F.try_to_timestamp("timestamp"))
    skew = F.expr(f"interval {skew_s} seconds")
    k = keys.select(F.col("key_id").alias("k"), "begins", "ends")
    within = (F.col("at") >= F.col("begins") - skew) & (F.col("ends").isNull() | (F.col("at") <= F.col("ends") + skew))
    return some.join(k, some["key_id"] == k["k"]).withColumn("within", F.coalesce(within, F.lit(False))).drop("k", "begins", "ends", "at")


def revoked_uses(records: DataFrame, revocations: DataFrame) -> DataFrame:
    """Certified records of revoked keys with `after`: whether they are as late as the earliest revocation or later."""
    first = revocations.groupBy("key_id").agg(F.min("revoked_at").alias("revoked_at"))
    some = records.filter("certificate_hash is not null and certificate_hash <> '' and key_id <> ''")
    return some.join(first, "key_id").withColumn("after", F.col("timestamp") >= F.col("revoked_at"))


def checkpoints(records: DataFrame) -> DataFrame:
    """(seq, tsa_url, status, gen_time) of checkpoints: what their tokens say of the hash that they stamp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [inspect(t or "", h or "") for t, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = [pa.array([x[k] for x in said], pa.string()) for k in ("status", "gen_time")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["seq", "tsa_url", "status", "gen_time"])

    marks = records.filter("event_type = 'chain_checkpoint' and checkpoint_context is not null")
    return marks.select("seq", "checkpoint_context.tsa_url", "checkpoint_context.tst_token_b64", "checkpoint_context.stamped_entry_hash").mapInArrow(run, "seq long, tsa_url string, status string, gen_time string")


def manifest_fields(m: dict) -> dict:
    """What the manifest's hash covers."""
    return {k: m.get(k) for k in ("key_id", "public_key", "deployer_id", "valid_from", "valid_until", "purpose", "manifest_version", "root_key_id")}


def build(records: DataFrame, chain: dict, start: str | None = None, end: str | None = None, articles: list[str] | None = None, decisions: bool = False, revocations: DataFrame | None = None) -> dict:
    """The report as a dict. chain: what verify() has returned."""
    period = in_period(records, start, end).cache()
    scope = touching(period, articles)
    span = period.agg(F.min("timestamp"), F.max("timestamp"), F.count_if("pii_in_log")).head()
    anomalies = list(chain["errors"]) + [f"seq={r[0]}: pii_in_log=true" for r in period.filter("pii_in_log").select("seq").orderBy("seq").collect()]
    rows = {r["article"]: r.asDict() for r in by_article(scope).collect()}
    sums: dict[str, dict[str, int]] = {}
    for a, c, n in article_categories(scope).orderBy("article", "category").collect():
        sums.setdefault(a, {})[c] = n
    per_article = {}
    for a in articles or sorted(rows):
        r = rows.get(a, {})
        one = {"evidence_event_count": r.get("evidence_event_count", 0), "decision_count": r.get("decision_count", 0), "pii_in_log": r.get("pii_in_log", False), "categories_detected": sums.get(a, {})}
        if a == ART_4A and r.get("bias_sessions"):
            one |= {"bias_sessions": r["bias_sessions"], "findings_recorded": r["findings_recorded"], "wipe_confirmed_pct": pct_of(r["bias_wiped"], r["bias_ends"])}
        if a == ART_50 and r.get("generation_events"):
            one |= {"generation_events": r["generation_events"], "labeled_events": r["labeled_events"], "label_coverage_pct": pct_of(r["labeled_events"], r["generation_events"]), "deepfake_events": r["deepfake_events"], "modality_distribution": {m: n for m, n in modalities(scope).orderBy("modality").collect()}}
        per_article[a] = one

    certified = scope.filter("certificate_hash is not null and certificate_hash <> ''")
    n_certified = certified.count()
    # A count of records that refer to a certificate: the log does not hold the certificates, so no signature is checked here.
    attestation = {"entries_with_certificates": n_certified, "certificate_references": n_certified, "key_ids": sorted(r[0] for r in certified.select("key_id").filter("key_id <> ''").distinct().collect())}
    keys = manifests(period).cache()
    known = keys.drop("begins", "ends").collect()
    provenance: dict = {}
    if known:
        valid = sum(digest(manifest_fields(m.asDict())) == m["manifest_hash"] for m in known)
        roots = dict.fromkeys(ROOT_STATES, 0)
        for m in known:
            roots["UNVERIFIED_NO_KEY" if m["root_signature"] else "NOT_REQUESTED"] += 1
        w = in_window(period, keys).agg(F.count("*"), F.count_if("within")).head()
        provenance |= {"manifests_found": len(known), "manifests_valid": valid, "within_validity_window_pct": pct_of(w[1], w[0]), "root_signature_status_distribution": roots}
    if revocations is not None:
        u = revoked_uses(period, revocations).agg(F.countDistinct("key_id"), F.count_if("after")).head()
        provenance |= {"revocation_checked": True, "revoked_keys_found": u[0], "certs_after_revocation": u[1]}
    marks = checkpoints(period).cache()
    stamped = {r[0] or "": r[1] for r in marks.groupBy("tsa_url").count().collect()}
    if stamped:
        bad = [f"seq={r[0]}: checkpoint token {r[1]}" for r in marks.filter("status <> 'UNVERIFIED'").select("seq", "status").orderBy("seq").collect()]
        provenance |= {"timestamped_checkpoints": sum(stamped.values()), "checkpoints_verified": 0, "earliest_claimed_time": marks.filter("status = 'UNVERIFIED'").agg(F.min("gen_time")).head()[0], "checkpoint_tsa_distribution": dict(sorted(stamped.items()))}
        anomalies += [*bad, "checkpoints not verified: signatures of timestamp tokens are not checked"]
    marks.unpersist()
    attestation["provenance_summary"] = provenance

    reasons = [] if chain["valid"] else [f"chain_integrity: broken ({len(chain['errors'])} faults)"]
    marked = [a for a, s in per_article.items() if s["pii_in_log"]]
    reasons += [f"per_article.{a}: pii_in_log=true" for a in marked]
    if span[2] and not marked:
        reasons.append("no_pii_in_logs: pii_in_log=true outside the scope")
    if (made := per_article.get(ART_50, {}).get("generation_events", 0)) > (labeled := per_article.get(ART_50, {}).get("labeled_events", 0)):
        reasons.append(f"per_article.{ART_50}: {made - labeled} of {made} generation events unlabeled")
    if known and provenance["manifests_valid"] < len(known):
        reasons.append(f"attestation: {provenance['manifests_valid']}/{len(known)} key manifests are consistent")
    if stamped:
        reasons.append(f"timestamping: 0/{sum(stamped.values())} checkpoints verified")
    out = {
        "report_metadata": {"generated_at": datetime.now(UTC).isoformat(timespec="microseconds"), "schema_version": SCHEMA_VERSION},
        "period": {"from": start or span[0], "to": end or span[1]},
        "articles_in_scope": articles,
        "chain_integrity": {"verdict": "verified" if chain["valid"] else "broken", "total_entries": scope.count(), "anomalies": anomalies},
        "per_article": per_article,
        "attestation": attestation,
        "coverage": coverage(),
        "verdict": "NON_COMPLIANT" if reasons else "COMPLIANT",
        "verdict_reasons": reasons,
    }
    if decisions:
        out["decisions"] = {r["decision_id"]: {"entry_count": r["entry_count"], "articles_touched": r["articles_touched"].split(",") if r["articles_touched"] else [], "categories": {k: int(n) for k, n in (x.rsplit("=", 1) for x in r["categories"].split(",") if x)}, "first_timestamp": r["first_timestamp"], "last_timestamp": r["last_timestamp"]} for r in by_decision(scope).collect()}
    period.unpersist()
    keys.unpersist()
    return out


def coverage() -> dict:
    names = ("title", "status", "provided", "deployer_responsibility")
    return {"articles": [{"article": a, **dict(zip(names, v, strict=True))} for a, v in COVERAGE.items()], "out_of_scope": list(OUT_OF_SCOPE)}


def as_json(report: dict) -> str:
    return json.dumps(json.loads(canonical(report)), indent=2, ensure_ascii=False)


def as_markdown(report: dict) -> str:
    lines = ["# Compliance report", "", f"Verdict: **{report['verdict']}**", f"Period: {report['period']['from']} to {report['period']['to']}", f"Chain: {report['chain_integrity']['verdict']}, {report['chain_integrity']['total_entries']} records", ""]
    lines += [f"- {r}" for r in report["verdict_reasons"]] + [""] * bool(report["verdict_reasons"])
    lines += ["| Article | Events | Decisions | Categories |", "|-|-|-|-|"]
    for a, s in report["per_article"].items():
        lines.append(f"| {a} | {s['evidence_event_count']} | {s['decision_count']} | {', '.join(f'{c}: {n}' for c, n in s['categories_detected'].items())} |")
    lines += ["", "## Attestation", "", *(f"- {k}: {v}" for k, v in report["attestation"].items()), "", "## Coverage", ""]
    lines += [f"- {c['article']} ({c['title']}, {c['status']}): {c['provided']}. Left to you: {c['deployer_responsibility']}." for c in report["coverage"]["articles"]]
    return "\n".join(lines) + "\n"


def content_log(records: DataFrame) -> tuple[dict, DataFrame]:
    """Counts of generated content and the synthetic events without a label."""
    made = records.filter("event_type = 'content_generation' and content_context.synthetic")
    row = made.agg(F.count("*").alias("generation_events"), F.count_if("content_context.labeled").alias("labeled_events"), F.count_if("content_context.deepfake").alias("deepfake_events")).head().asDict()
    row["label_coverage_pct"] = pct_of(row["labeled_events"], row["generation_events"])
    return row, made.filter("not coalesce(content_context.labeled, false)").select("seq", "event_id", "timestamp").orderBy("timestamp", "seq")
