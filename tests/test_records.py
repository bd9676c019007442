import base64
import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilwork.__main__ import parser
from veilwork.config import Mask
from veilwork.errors import ChainIntegrityError, ConfigError, SchemaViolation, ScopeError, SessionState, SessionTimeout
from veilwork.functions.canonical import canonical, entry_hash, text_hash
from veilwork.functions.ed25519 import Keys
from veilwork.operators import attest, audit, report, settings
from veilwork.operators.audit_schema import violations
from veilwork.operators.bias import BiasSession
from veilwork.operators.timestamps import inspect
from veilwork.sources.audit_log import AuditLog, last_valid, read_lines, records


def test_canonical_json():
    assert canonical({"b": [1, 0.0, 1e-7, None], "a": {"é": "x", "A": True}}) == '{"a":{"A":true,"é":"x"},"b":[1,0.0,1e-07,null]}'
    for bad in (float("nan"), float("inf"), {"x": [{"constructor": 1}]}):
        with pytest.raises(ValueError):
            canonical(bad)
    assert text_hash("") == ""


def chain(folder, n=4, **options):
    log = AuditLog(folder, compliance=True, **options)
    for i in range(n):
        log.append({"event_type": "sanitize", "entity_count": i, "categories": {"EMAIL": i}, "model": "m", "decision_id": f"d{i % 2}"})
    return log


def test_chain_is_written_continued_and_verified(spark, tmp_path):
    chain(tmp_path)
    chain(tmp_path, 2)
    lines = read_lines(spark, str(tmp_path))
    assert audit.verify(lines) == {"valid": True, "errors": [], "final_seq": 5}
    assert last_valid(lines)[0] == 5
    got = audit.stats(records(lines))
    assert (got["total_events"], got["total_entities"], got["categories"]) == (6, 7, {"EMAIL": 7})
    assert audit.schema_faults(lines).count() == 0


def test_tampering_broken_lines_and_restart(spark, tmp_path):
    chain(tmp_path)
    path = next(tmp_path.glob("audit_*.jsonl"))
    parts = path.read_text().split("\n")
    parts[2] = parts[2].replace('"entity_count": 2', '"entity_count": 9')
    path.write_text("\n".join(parts))
    assert [e.split("-- ")[1] for e in audit.verify(read_lines(spark, str(tmp_path)))["errors"]] == ["entry tampered"]
    parts[1] = "{cut"
    path.write_text("\n\n".join(parts) + "{half")
    got = audit.verify(read_lines(spark, str(tmp_path)))
    assert sorted(e.split("-- ")[1] for e in got["errors"]) == ["chain broken", "entry tampered", "invalid JSON", "invalid JSON"]
    with pytest.raises(ChainIntegrityError):
        AuditLog(tmp_path, strict=True)
    AuditLog(tmp_path).append({"event_type": "sanitize"})
    assert json.loads(path.read_text().strip().split("\n")[-1])["seq"] == 4


def test_no_log_is_a_valid_log(spark, tmp_path):
    assert audit.verify(read_lines(spark, str(tmp_path))) == {"valid": True, "errors": [], "final_seq": 0}


def test_writers_do_not_tear_lines(tmp_path):
    logs = [AuditLog(tmp_path) for _ in range(4)]
    threads = [threading.Thread(target=lambda w=w: [w.append({"event_type": "sanitize", "metadata": {"x": "y" * 200}}) for _ in range(20)]) for w in logs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len([json.loads(x) for x in next(tmp_path.glob("*.jsonl")).read_text().strip().split("\n")]) == 80


def test_folds_equal_a_loop(spark):
    rows = [("a", i, json.dumps({"event_type": "sanitize", "n": i * 0.0})) for i in range(5)] + [("b", i, "{}") for i in range(3)]
    got = audit.chained(spark.createDataFrame(rows, "log string, seq int, entry string"), chain="log").collect()
    for name in "ab":
        last = "0" * 64
        for r in sorted((r for r in got if r["log"] == name), key=lambda r: r["seq"]):
            assert r["prev_hash"] == last
            last = r["entry_hash"]
            assert entry_hash(json.loads(r["entry"])) == last


@pytest.mark.parametrize(
    ("entry", "fault"),
    [
        ({"name": "x"}, "name"),
        ({"entity_details": [{"value": "a@b.co"}]}, "a value of the text"),
        ({"metadata": {"a": {"b": {"c": {"d": 1}}}}}, "nested"),
        ({"metadata": {"a": "x" * 257}}, "256"),
        ({"decision_id": "a b"}, "decision_id"),
        ({"event_type": "sanitize", "bias_context": {}}, "not in a record"),
        ({"event_type": "content_generation", "content_context": {"text": "x", "modality": "text", "synthetic": True, "labeled": True, "disclosure_method": "none", "deepfake": False}}, "content itself"),
        ({"event_type": "content_generation", "content_context": {"modality": "smell", "synthetic": 1, "labeled": True, "disclosure_method": "none", "deepfake": False}}, "bad value"),
        ({"event_type": "chain_checkpoint", "checkpoint_context": {"stamped_entry_hash": "zz", "tsa_url": "http://x", "tst_token_b64": "a", "hash_algorithm": "md5", "stamped_seq": -1}}, "bad value"),
        ({"event_type": "key_registered", "key_manifest": {"key_id": "k"}}, "missing"),
        ({"system_version_pin": "x" * 300}, "system_version_pin"),
    ],
)
def test_schema(entry, fault, tmp_path):
    assert any(fault in v for v in violations(entry))
    with pytest.raises(SchemaViolation):
        AuditLog(tmp_path).append(entry)


def test_report(spark, tmp_path):
    log = chain(tmp_path)
    keys = Keys(spark)
    _, public = keys.generate()
    m = attest.derive_manifest(public, "us", "2020-01-01T00:00:00Z", "2040-01-01T00:00:00Z")
    log.append({"event_type": "key_registered", "key_manifest": m})
    log.append({"event_type": "sanitize", "certificate_hash": "c", "key_id": m["key_id"], "categories": {"EMAIL": 1}})
    for labeled in (True, False):
        log.append({"event_type": "content_generation", "content_context": {"modality": "text", "synthetic": True, "labeled": labeled, "disclosure_method": "none", "deepfake": False}})
    log.append({"event_type": "content_generation", "content_context": {"modality": "image", "synthetic": False, "labeled": False, "disclosure_method": "none", "deepfake": False}})
    lines = read_lines(spark, str(tmp_path))
    revoked = spark.createDataFrame([(m["key_id"], "2021-01-01T00:00:00+00:00")], "key_id string, revoked_at string")
    got = report.build(records(lines), audit.verify(lines), decisions=True, revocations=revoked)
    a50 = got["per_article"][report.ART_50]
    assert (a50["evidence_event_count"], a50["generation_events"], a50["label_coverage_pct"]) == (3, 2, 50)
    assert got["per_article"]["EU_AI_Act_Art_12"]["categories_detected"] == {"EMAIL": 7}
    p = got["attestation"]["provenance_summary"]
    assert (p["manifests_found"], p["manifests_valid"], p["within_validity_window_pct"], p["certs_after_revocation"]) == (1, 1, 100, 1)
    assert got["decisions"]["d0"]["entry_count"] == 2
    assert got["verdict"] == "NON_COMPLIANT"
    assert "EU_AI_Act_Art_50" in report.as_markdown(got)
    json.loads(report.as_json(got))
    only = report.build(records(lines), audit.verify(lines), articles=[report.ART_4A])
    assert only["per_article"] == {report.ART_4A: {"evidence_event_count": 0, "decision_count": 0, "pii_in_log": False, "categories_detected": {}}}
    counts, unlabeled = report.content_log(records(lines))
    assert (counts["generation_events"], unlabeled.count()) == (2, 1)


def der(tag, *parts):
    body = b"".join(parts)
    return bytes([tag, len(body)]) + body if len(body) < 128 else bytes([tag, 0x82]) + len(body).to_bytes(2, "big") + body


def token(digest):
    oid = lambda h: der(6, bytes.fromhex(h))
    info = der(0x30, der(2, b"\1"), oid("2a03"), der(0x30, der(0x30, oid("608648016503040201"), der(5)), der(4, digest)), der(2, b"\7"), der(0x18, b"20260701100000Z"))
    signed = der(0x30, der(2, b"\3"), der(0x31), der(0x30, oid("2a864886f70d0109100104"), der(0xA0, der(4, info))), der(0x31))
    return base64.b64encode(der(0x30, oid("2a864886f70d010702"), der(0xA0, signed))).decode()


def test_timestamp_tokens_are_read_but_never_verified(spark, tmp_path):
    digest = bytes(range(32))
    assert inspect(token(digest), digest.hex()) == {"status": "UNVERIFIED", "gen_time": "2026-07-01T10:00:00+00:00", "hash_algorithm": "sha256", "reason": None}
    assert inspect(token(digest), "00" * 32)["status"] == "MISMATCH"
    whole = base64.b64decode(token(digest))
    for n in range(len(whole)):
        assert inspect(base64.b64encode(whole[:n]).decode(), digest.hex())["status"] == "MALFORMED"
    log = chain(tmp_path, 1)
    for stamped in (digest.hex(), "00" * 32):
        log.append({"event_type": "chain_checkpoint", "checkpoint_context": {"stamped_entry_hash": stamped, "tsa_url": "https://tsa.example", "tst_token_b64": token(digest), "hash_algorithm": "sha256", "stamped_seq": 0}})
    lines = read_lines(spark, str(tmp_path))
    got = report.build(records(lines), audit.verify(lines))
    p = got["attestation"]["provenance_summary"]
    assert (p["timestamped_checkpoints"], p["checkpoints_verified"], p["earliest_claimed_time"]) == (2, 0, "2026-07-01T10:00:00+00:00")
    assert "seq=2: checkpoint token MISMATCH" in got["chain_integrity"]["anomalies"]
    assert got["verdict"] == "NON_COMPLIANT"


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    settings.export(Mask(hash_key="aa"), str(path))
    got = json.loads(path.read_text())
    assert got["options"]["hash_key"] == "set"
    assert "EMAIL" in got["categories"]
    (tmp_path / "link").symlink_to(path)
    with pytest.raises(ConfigError):
        settings.export(Mask(), str(tmp_path / "link"))


def test_percentages():
    assert [report.pct_of(n, d) for n, d in ((1, 800), (1, 3), (2, 2), (0, 0))] == [0.13, 33.33, 100, 0]


def test_merkle_for_every_size(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for n in (1, 2, 3, 5, 8, 13):
        hashes = [sha(str(i)) for i in range(n)]
        level = hashes
        while len(level) > 1:
            level = [sha(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        leaves = attest.numbered(spark.createDataFrame(list(enumerate(hashes)), "id long, h string"), "id", "h")
        assert attest.merkle_root(leaves) == level[0]
        proofs = attest.merkle_proofs(leaves)
        assert {r[0] for r in proofs.select(attest.proven_root(F.col("hash"), F.col("proof"))).collect()} == {level[0]}
    assert attest.merkle_root(spark.createDataFrame([], "idx long, hash string")) is None


def test_certificates_manifests_revocation(spark, tmp_path):
    keys = Keys(spark)
    private, public = keys.generate()
    root_private, root_public = keys.generate()
    attest.save_keys(str(tmp_path / "k.json"), private, public)
    assert attest.load_keys(str(tmp_path / "k.json")) == (private, public)
    c = attest.certify(keys, private, public, "i", "o", 1, {"EMAIL": 1}, ["regex"], "tokenize")
    assert attest.certificate_valid(keys, c)
    assert not attest.certificate_valid(keys, c | {"entity_count": 2})
    sign = lambda data: keys.sign(root_private, data)
    m = attest.derive_manifest(public, "us", "2020-01-01T00:00:00Z", None, sign_root=sign, root_key_id="root")
    good = attest.provenance(keys, c, m, root_public=root_public)
    assert good["overall_valid"] is True
    assert attest.provenance(keys, c, m)["overall_valid"] is None
    assert attest.provenance(keys, c, m | {"deployer_id": "them"}, root_public=root_public)["overall_valid"] is False
    late = attest.derive_revocations("us", [{"key_id": m["key_id"], "revoked_at": "2039-01-01T00:00:00Z", "reason": "x"}], "2039-01-01T00:00:00Z")
    early = attest.derive_revocations("us", [{"key_id": m["key_id"], "revoked_at": "2020-01-01T00:00:00Z", "reason": "x"}], "2020-01-01T00:00:00Z")
    assert attest.revocation_status(keys, late, m["key_id"], c["timestamp"]) == "PREDATES_REVOCATION"
    assert attest.revocation_status(keys, early, m["key_id"], c["timestamp"]) == "REVOKED"
    assert attest.revocation_status(keys, early, m["key_id"], "some day") == "REVOKED"
    assert attest.revocation_status(keys, early | {"entries": []}, m["key_id"], c["timestamp"]) == "LIST_INVALID"
    with pytest.raises(ConfigError):
        attest.derive_revocations("us", [{"key_id": m["key_id"], "revoked_at": "2021-01-01T00:00:00Z", "reason": ""}], "2021-01-01T00:00:00Z", before=early)
    with pytest.raises(ConfigError):
        attest.derive_manifest(public, "us", "2020-01-01")


def test_bias_session(spark):
    said, now = [], [0.0]
    texts = spark.createDataFrame([(1, "Ana is from Peru and Ana prays"), (2, "none")], "id long, text string")
    spans = spark.createDataFrame([(1, 0, 3, "ETHNICITY"), (1, 21, 24, "ETHNICITY"), (1, 25, 30, "RELIGION")], "id long, start int, end int, category string")
    with BiasSession("fairness", "no other data", ["ETHNICITY", "RELIGION"], record=said.append) as s:
        got = {r["id"]: r["masked"] for r in s.pseudonymise(texts, spans).collect()}
        s.finding("parity", gap=0.1)
        later = spark.createDataFrame([(9, "Eva met Ana")], "id long, text string"), spark.createDataFrame([(9, 0, 3, "ETHNICITY"), (9, 8, 11, "ETHNICITY")], "id long, start int, end int, category string")
        more = s.pseudonymise(*later)
        written = [p for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet") if s.id in str(p)]
        assert written
    assert not any(p.exists() for p in written)
    assert said[-1]["bias_context"]["wipe_confirmed"]
    assert more.head()["masked"] == "[ETHNICITY_1] met [ETHNICITY_0]"
    assert got == {1: "[ETHNICITY_0] is from Peru and [ETHNICITY_0] [RELIGION_0]", 2: "none"}
    assert [e["event_type"] for e in said] == ["bias_session_start", "bias_pseudonymise", "bias_finding", "bias_pseudonymise", "bias_session_end"]
    assert not [v for e in said for v in violations(e)]
    with pytest.raises(SessionState):
        s.finding("late")
    with pytest.raises(ScopeError):
        BiasSession("p", "j", ["EMAIL"])
    with pytest.raises(ScopeError):
        BiasSession("p‮", "j", ["RACE"])
    timed = BiasSession("p", "j", ["RACE"], lifetime_s=5, record=said.append, clock=lambda: now[0])
    now[0] = 6.0
    with pytest.raises(SessionTimeout):
        timed.finding("late")
    assert said[-1]["bias_context"]["exit_reason"] == "timeout"
    with BiasSession("p", "j", ["RACE"]) as narrow, pytest.raises(ScopeError):
        narrow.pseudonymise(texts, spans)


def test_command_line(tmp_path, capsys, monkeypatch, spark):
    monkeypatch.setattr("veilwork.__main__.session", lambda: spark)
    run = lambda *a: (lambda x: x.run(x))(parser().parse_args(a))
    assert run("scan", "mail a@b.co") == 0
    assert json.loads(capsys.readouterr().out)["redacted"] == "mail [EMAIL_REDACTED]"
    chain(tmp_path)
    assert run("verify", str(tmp_path)) == 0
    assert run("compliance-report", str(tmp_path), "--format", "markdown") == 0
    assert run("content-log", str(tmp_path)) == 0
    assert run("key-manifest", "generate", "--keys", str(tmp_path / "k"), "--deployer", "us", "--valid-from", "2024-01-01T00:00:00Z") == 0


def test_a_roundtrip_makes_its_chain_once(spark, data):
    from veilwork.plans.compliance import chain_roundtrip

    out = chain_roundtrip(spark, data)
    plan = str(out._jdf.queryExecution().executedPlan())
    assert plan.count("MapInArrow run") == 2  # the chain, and the hashes of both logs
    assert {r["log"]: r["records"] - r["intact"] > 0 for r in out.collect()} == {"as written": False, "changed": True}
