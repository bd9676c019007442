"""Masking and restoring with records."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veilwork.__main__ import parser
from veilwork.config import Detect, Mask
from veilwork.errors import ConfigError, SchemaViolation
from veilwork.operators import audit, guard
from veilwork.operators.audit_schema import violations
from veilwork.sources.audit_log import AuditLog, read_lines

KEY = "00112233445566778899aabbccddeeff"
ROWS = [(1, "s", "mail a@b.com and c@d.org"), (2, "s", "again a@b.com, [EMAIL_7]"), (3, None, "x@y.net"), (None, None, None), (4, "t", ""), (5, "t", "q@r.com"), (5, "t", "q@r.com")]


def texts(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, conv string, text string").withColumn("spans", F.lit("kept")).withColumn("key", F.lit(1))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def test_records_tell_what_was_masked_and_no_value(spark):
    how = Mask(detect=Detect(only=("EMAIL",)), hash_key=KEY)
    rows, tokens, records = guard.sanitized(texts(spark), how, session="conv", call=guard.Call("m", "p", "d", "i"))
    got = {(r["doc_id"], r["text"]): r for r in rows.collect()}
    assert len(got) == 6 and rows.count() == 7 and {r["spans"] for r in got.values()} == {"kept"}
    assert got[1, ROWS[0][2]]["masked"] == "mail [EMAIL_1] and [EMAIL_0]"
    assert got[2, ROWS[1][2]]["masked"] == "again [EMAIL_1], ［EMAIL_7］"
    assert got[3, "x@y.net"]["masked"] == "[EMAIL_0]" and got[None, None]["masked"] is None
    assert tokens.count() == 4
    for r in records.collect():
        text = next(t for k, s, t in ROWS if k == r["key_doc_id"])
        masked = got[r["key_doc_id"], text]["masked"]
        assert (r["prompt_hash"], r["sanitized_hash"]) == (sha(text), sha(masked))
        assert r["entity_count"] == len(r["entity_details"]) == sum(r["categories"].values())
        assert r["system_version_pin"] == "m@d/i" and len(r["decision_id"]) == 26
        assert r["decision_id"] == got[r["key_doc_id"], text]["decision_id"]
    for r in guard.entries(records, "key_doc_id").collect():
        entry = json.loads(r["entry"])
        assert violations(entry) == []
        assert "@" not in r["entry"].replace("m@d/i", "")


def test_each_key_is_a_session_of_its_own_and_redaction_keeps_nothing(spark):
    rows, tokens, _ = guard.sanitized(texts(spark), Mask(detect=Detect(only=("EMAIL",))))
    assert {r["masked"] for r in rows.filter("doc_id in (3, 5)").collect()} == {"[EMAIL_0]"}
    rows, tokens, records = guard.sanitized(texts(spark), Mask("redact", Detect(only=("EMAIL",)), KEY))
    assert tokens.count() == 0 and rows.filter("doc_id = 1").head()["masked"] == "mail [EMAIL_REDACTED] and [EMAIL_REDACTED]"
    one = records.filter("key_doc_id = 1").head()
    assert one["tokens_used"] == ["[EMAIL_REDACTED]"] and one["categories"] == {"EMAIL": 2} and len(one["entity_details"][0]["entity_hash"]) == 64
    back, records = guard.desanitized(rows, tokens, mode="redact")
    assert back.filter("doc_id = 1").head()["restored"] == "mail [EMAIL_REDACTED] and [EMAIL_REDACTED]" and records.count() == 7


def test_restoring_inherits_the_decision_and_hashes_the_masked_text(spark):
    masked, tokens, first = guard.sanitized(texts(spark), Mask(detect=Detect(only=("EMAIL",))), session="conv")
    rows, records = guard.desanitized(masked, tokens, session="conv")
    assert {(r["doc_id"], r["restored"]) for r in rows.collect()} == {(k, t) for k, _, t in ROWS}
    ids = {(r["key_doc_id"], r["decision_id"]) for r in first.collect()}
    assert {(r["key_doc_id"], r["decision_id"]) for r in records.collect()} == ids
    by = {r["key_doc_id"]: r for r in records.collect()}
    assert by[1]["tokens_used"] == ["[EMAIL_0]", "[EMAIL_1]"] and by[1]["entity_count"] == 2 and by[4]["tokens_used"] == []
    assert by[1]["prompt_hash"] == by[1]["sanitized_hash"] == sha("mail [EMAIL_1] and [EMAIL_0]")
    answer = spark.createDataFrame([("s", "to [email_1] and [EMAIL_9]", "mine")], "conv string, masked string, asked string")
    rows, records = guard.desanitized(answer, tokens, key="conv", decision="asked")
    assert rows.head()["restored"] == "to a@b.com and [EMAIL_9]"
    assert records.head()["decision_id"] == "mine" and records.head()["tokens_used"] == []


def test_a_batch_is_one_record_in_the_chain(spark, tmp_path):
    _, _, records = guard.sanitized(texts(spark), Mask(detect=Detect(only=("EMAIL",))), session="conv")
    one = guard.batch_record(records)
    assert one["entity_count"] == 6 and one["categories"] == {"EMAIL": 6} and one["metadata"]["texts"] == 7 and len(one["metadata"]["input_merkle_root"]) == 64
    log = AuditLog(tmp_path, compliance=True)
    log.append(one)
    log.append(guard.generation_record("text", "metadata", content="made"))
    assert audit.verify(read_lines(spark, str(tmp_path)))["valid"]
    none = guard.sanitized(texts(spark, []), Mask())[2]
    assert none.count() == 0 and guard.batch_record(none)["entity_count"] == 0
    whole = audit.chained(guard.entries(records.withColumn("n", F.monotonically_increasing_id()), "n"), "n")
    assert whole.count() == 7


def test_events_and_alerts(spark):
    with pytest.raises(SchemaViolation):
        guard.generation_record("smell", "none")
    with pytest.raises(ConfigError):
        guard.key_record({"key_id": "other"}, b"x" * 32)
    rows = spark.createDataFrame([(i, "sanitize" if i != 5 else "chain_checkpoint") for i in range(9)], "seq long, event_type string")
    assert [r[0] for r in guard.checkpoints_due(rows, 3).orderBy("seq").collect()] == [2, 8]
    scored = spark.createDataFrame([(1, 0.7), (2, 0.71), (3, None)], "doc_id long, risk_score double")
    assert [r[0] for r in guard.alerts(scored).collect()] == [2]


def test_keys_are_revoked_once(tmp_path, capsys):
    def run(*words):
        a = parser().parse_args(["key-manifest", "revoke", *words])
        return a.run(a)

    first = ["--deployer", "us", "--key-id", "k1", "--revoked-at", "2024-01-01T00:00:00Z", "--reason", "lost"]
    assert run(*first) == 0
    listing = capsys.readouterr().out
    (tmp_path / "r").write_text(listing)
    assert json.loads(listing)["entries"] == [{"key_id": "k1", "revoked_at": "2024-01-01T00:00:00Z", "reason": "lost"}]
    assert run(*first, "--revocations", str(tmp_path / "r")) == 1
    assert run("--deployer", "us", "--key-id", "k2", "--revocations", str(tmp_path / "r")) == 0
    assert run("--deployer", "them", "--key-id", "k2", "--revocations", str(tmp_path / "r")) == 1
    assert run("--deployer", "us", "--key-id", "k3", "--revoked-at", "yesterday") == 1


def test_restoring_reads_texts_that_were_masked_once(spark, data, monkeypatch):
    from veilwork.functions import tokens
    from veilwork.operators import guard
    from veilwork.plans.detection import guard_desanitize

    plans, own = [], guard.desanitized
    monkeypatch.setattr(guard, "desanitized", lambda masked, *a, **b: plans.append(masked._jdf.queryExecution().optimizedPlan().toString()) or own(masked, *a, **b))
    assert guard_desanitize(spark, data).count() > 0
    assert len(plans) == 1
    assert "regexp_replace" not in plans[0]  # the escape of masking
    assert tokens.OPEN not in plans[0]
