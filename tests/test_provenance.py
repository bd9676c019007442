"""Signatures over integers, and provenance over tables against one certificate at a time."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilwork.functions import ed25519
from veilwork.functions.ed25519 import Keys, key_id, public_of, signed, verified
from veilwork.operators import attest
from veilwork.operators.provenance import moment_of, provenance

# Test vectors of RFC 8032, section 7.1 (private key, public key, message, signature).
VECTORS = [
    (
        "9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "",
        "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b",
    ),
    (
        "4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72",
        "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00",
    ),
]


@pytest.mark.parametrize(("private", "public", "message", "signature"), VECTORS)
def test_vectors(private, public, message, signature):
    private, public, message, signature = map(bytes.fromhex, (private, public, message, signature))
    assert public_of(private) == public
    assert signed(private, message) == signature
    assert verified(public, message, signature)


def test_integers_agree_with_the_jdk(spark):
    keys, rnd = Keys(spark), random.Random(3)
    for n in range(12):
        private, public = keys.generate()
        data = rnd.randbytes(n * 7)
        assert public_of(private) == public
        assert signed(private, data) == keys.sign(private, data)
        good = keys.sign(private, data)
        bad = [bytes([good[0] ^ 1]) + good[1:], good[:32] + bytes([good[32] ^ 1]) + good[33:], good[:63], good[:32] + b"\xff" * 32, b"\0" * 64]
        for s in (good, *bad):
            assert verified(public, data, s) == keys.verify(public, data, s)
        assert not verified(public, data + b"x", good)
        assert not verified(rnd.randbytes(31), data, good)
    assert not verified(b"\xff" * 32, b"", b"\0" * 64)


def test_keys_met_often_cost_no_doublings(monkeypatch):
    """Points are added by tables: a row costs additions alone, whatever the number of rows."""
    private, steps = b"k" * 32, []
    public = public_of(private)
    first = signed(private, b"0")
    assert all(verified(public, b"0", first) for _ in range(4))
    own = ed25519._sum
    monkeypatch.setattr(ed25519, "_sum", lambda a, b: steps.append(1) or own(a, b))
    for n in range(20):
        data = str(n).encode()
        s = signed(private, data)
        assert verified(public, data, s)
        assert not verified(public, data + b"x", s)
    assert not steps


CHECKS = ("signature_valid", "key_id_matches", "within_validity_window", "manifest_hash_consistent", "root_signature_status", "revocation_status", "overall_valid")
TIMES = ["2026-01-05T00:00:00+00:00", "2026-01-05T00:00:00Z", "2025-12-31T23:56:00Z", "2025-12-31T23:54:59Z", "2026-02-01T00:04:59.5+00:00", "2026-02-01T02:05:01+02:00", "2026-01-20T10:00:00", "no time", None]


@pytest.mark.parametrize("rooted", [None, "known", "unknown"])
def test_tables_equal_one_at_a_time(spark, rooted):
    keys = Keys(spark)
    root_private, root_public = keys.generate()
    sign = (lambda d: keys.sign(root_private, d)) if rooted else None
    root = {"sign_root": sign, "root_key_id": key_id(root_public) if rooted else None}
    pairs = [keys.generate() for _ in range(4)]
    manifests = [attest.derive_manifest(p, "d", "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z" if k else None, **root) for k, (_, p) in enumerate(pairs[:3])]
    manifests[2]["deployer_id"] = "changed"
    by_key = {m["key_id"]: m for m in manifests}
    revocations = attest.derive_revocations("d", [{"key_id": key_id(pairs[1][1]), "revoked_at": "2026-01-04T00:00:00Z", "reason": "x"}], "2026-01-06T00:00:00Z", **root)
    rows = []
    for private, public in pairs:
        for k, t in enumerate(TIMES):
            c = attest.certify(keys, private, public, "i", "o", 1, {"EMAIL": 1}, ["regex"], "tokenize") | {"timestamp": t}
            c["signature"] = attest.b64(keys.sign(private, attest.signed_part(c)))
            if k == 1:
                c["output_hash"] = "other"
            if k == 2:
                c["signature"] = "!"
            rows.append(c)
    table = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(rows)] + [(100, None), (101, "[]"), (102, "{")], "overall int, certificate string")
    listed = spark.createDataFrame([(json.dumps(m),) for m in manifests] + [(None,), ("x",), ("{}",)], "manifest string")
    own = root_public if rooted == "known" else None
    for rev in (None, revocations, revocations | {"issued_at": "2027-01-01T00:00:00Z"}):
        got = {r["overall"]: r for r in provenance(table, listed, rev, own).collect()}
        assert len(got) == len(rows) + 3
        for i, c in enumerate(rows):
            if m := by_key.get(c["key_id"]):
                want = attest.provenance(keys, c, m, rev, own)
                assert {k: got[i][k] for k in CHECKS} == {k: want[k] for k in CHECKS}, (i, c["timestamp"])
                assert got[i]["manifest_found"]
            else:
                assert (got[i]["manifest_found"], got[i]["signature_valid"], got[i]["overall_valid"]) == (False, None, None)
        assert not any(got[i]["manifest_found"] for i in (100, 101, 102))
    assert provenance(table.limit(0), listed).count() == 0
    assert not provenance(table, listed.limit(0)).filter("manifest_found").count()


def test_a_key_in_use_again_has_the_manifest_of_the_time(spark):
    private = bytes(range(32))
    public, keys = public_of(private), Keys(spark)
    spans = [("2026-01-01T00:00:00Z", "2026-01-10T00:00:00Z"), ("2026-02-01T00:00:00Z", None)]
    listed = spark.createDataFrame([(json.dumps(attest.derive_manifest(public, "d", b, e)),) for b, e in spans], "manifest string")
    rows = []
    for i, t in enumerate(("2026-01-05T00:00:00Z", "2026-01-20T00:00:00Z", "2026-03-01T00:00:00Z")):
        c = attest.certify(keys, private, public, "i", "o", 0, {}, [], "tokenize") | {"timestamp": t}
        rows.append((i, json.dumps(c | {"signature": attest.b64(signed(private, attest.signed_part(c)))})))
    got = provenance(spark.createDataFrame(rows, "i int, certificate string"), listed).orderBy("i").collect()
    assert [(r["within_validity_window"], r["overall_valid"]) for r in got] == [(True, True), (False, False), (True, True)]


def test_moments_of_columns_are_those_of_one(spark):
    texts = [*[t for t in TIMES if t], "2026-13-01T00:00:00Z", "2026-01-01 00:00:00Z", "2026-01-01T00:00:00.123456Z", "2026-01-01T25:00:00Z", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(moment_of(F.col("t")).cast("double")).collect()]
    assert got == [m.timestamp() if (m := attest.moment(t)) else None for t in texts]
