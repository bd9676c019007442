"""Command line: scan, verify, stats, compliance-report, content-log, key-manifest (generate, show, verify, revoke). Exit code 1 tells of a failed check."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilwork.config import Detect
from veilwork.errors import ConfigError
from veilwork.functions.ed25519 import Keys
from veilwork.functions.tokens import redact
from veilwork.operators import attest, audit, masking, report
from veilwork.sources.audit_log import read_lines, records


def session() -> SparkSession:
    return SparkSession.builder.appName("veilwork").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def scan(a: argparse.Namespace) -> int:
    text = sys.stdin.read() if a.text == "-" else a.text
    found = masking.detected(session().createDataFrame([(text,)], "text string"), Detect(locale=a.locale))
    row = masking.analysis(found, "text", values=a.values).join(found.select("text", redact(F.col("text"), F.col("spans")).alias("redacted")), "text").head()
    print(json.dumps({"entity_count": row["entity_count"], "entities": [e.asDict() for e in row["entities"]], "redacted": row["redacted"]}, ensure_ascii=False, indent=2))
    return 0


def verify(a: argparse.Namespace) -> int:
    got = audit.verify(read_lines(session(), a.folder))
    print(json.dumps(got, indent=2))
    return 0 if got["valid"] else 1


def stats(a: argparse.Namespace) -> int:
    print(json.dumps(audit.stats(records(read_lines(session(), a.folder))), indent=2))
    return 0


def compliance(a: argparse.Namespace) -> int:
    spark = session()
    lines = read_lines(spark, a.folder)
    revoked = None
    if a.revocations:
        entries = json.loads(Path(a.revocations).read_text())["entries"]
        revoked = spark.createDataFrame([(e["key_id"], e["revoked_at"]) for e in entries], "key_id string, revoked_at string")
    got = report.build(records(lines), audit.verify(lines), a.start, a.end, a.article or None, a.decisions, revoked)
    out = report.as_markdown(got) if a.format == "markdown" else report.as_json(got)
    Path(a.out).write_text(out) if a.out else print(out)
    return 0 if got["verdict"] == "COMPLIANT" else 1


def content_log(a: argparse.Namespace) -> int:
    counts, unlabeled = report.content_log(records(read_lines(session(), a.folder, "*.jsonl")))
    events = [r.asDict() for r in unlabeled.collect()]
    print(json.dumps(counts | {"unlabeled": events}, indent=2))
    return 1 if events else 0


def manifest(a: argparse.Namespace) -> int:
    if a.action in ("generate", "verify"):
        keys = Keys(session())
    if a.action == "generate":
        private, public = keys.generate()
        attest.save_keys(a.keys, private, public)
        print(json.dumps(attest.derive_manifest(public, a.deployer, a.valid_from, a.valid_until), indent=2))
        return 0
    if a.action == "revoke":  # without a root key, whose signature is made elsewhere
        before = json.loads(Path(a.revocations).read_text()) if a.revocations else None
        if before and before["deployer_id"] != a.deployer:
            print("the list is another deployer's", file=sys.stderr)
            return 1
        at = a.revoked_at or datetime.now(UTC).isoformat()
        try:
            listing = attest.derive_revocations(a.deployer, [{"key_id": a.key_id, "revoked_at": at, "reason": a.reason}], datetime.now(UTC).isoformat(), before)
        except ConfigError as e:
            print(e, file=sys.stderr)
            return 1
        print(json.dumps(listing, indent=2))
        return 0
    m = json.loads(Path(a.manifest).read_text())
    if a.action == "show":
        print(json.dumps(m, indent=2))
        return 0
    got = attest.provenance(keys, json.loads(Path(a.certificate).read_text()), m, json.loads(Path(a.revocations).read_text()) if a.revocations else None)
    print(json.dumps(got, indent=2))
    return 0 if got["overall_valid"] else 1


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilwork")
    sub = p.add_subparsers(required=True)

    def add(name: str, run, *options: tuple[str, dict]) -> None:
        s = sub.add_parser(name)
        for option, how in options:
            s.add_argument(option, **how)
        s.set_defaults(run=run)

    add("scan", scan, ("text", {}), ("--locale", {}), ("--values", {"action": "store_true"}))
    add("verify", verify, ("folder", {}))
    add("stats", stats, ("folder", {}))
    add("compliance-report", compliance, ("folder", {}), ("--start", {}), ("--end", {}), ("--article", {"action": "append"}), ("--decisions", {"action": "store_true"}), ("--revocations", {}), ("--format", {"choices": ["json", "markdown"], "default": "json"}), ("--out", {}))
    add("content-log", content_log, ("folder", {}))
    add("key-manifest", manifest, ("action", {"choices": ["generate", "show", "verify", "revoke"]}), ("--keys", {"default": "keys.json"}), ("--deployer", {"default": ""}), ("--valid-from", {}), ("--valid-until", {}), ("--manifest", {}), ("--certificate", {}), ("--revocations", {}), ("--key-id", {}), ("--revoked-at", {}), ("--reason", {"default": ""}))
    return p


if __name__ == "__main__":
    args = parser().parse_args()
    sys.exit(args.run(args))
