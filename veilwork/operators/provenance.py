"""Provenance over tables: certificates against the manifests of their keys and a revocation list, as columns.

What `attest.provenance` says of one certificate and one manifest, for any number of both. Certificates are joined to manifests by key; a key
has few manifests (one for each time it is put in use), so they come as one array a key, and which one holds at a certificate's time is an expression
over it: nothing is shuffled for it, and no row is multiplied. That join is left to Spark, which sends manifests about while they are few and
splits a key that signs very much. Signatures are checked on executors, in Arrow batches.

Defined results: of a key's manifests the one that begins last among those whose window holds the time is taken, else the one that begins last.
A certificate whose key has no manifest has manifest_found false, nulls for what a manifest tells, and overall_valid null: it cannot be said.
overall_valid is null too where only the root key is missing. Certificates and manifests that are null or no JSON are found by no key. Rows alike
are judged each for itself; other columns are carried along, empty tables give empty ones.
"""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.canonical import digest
from veilwork.functions.ed25519 import key_id, verified
from veilwork.operators.attest import moment, revocation_hash, signed_part
from veilwork.operators.report import manifest_fields

_iso = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$"
_manifest = "key_id string, public_key string, begins timestamp, ends timestamp, open boolean, id_matches boolean, hash_consistent boolean, root string"


def moment_of(text: Column) -> Column:
    """A time with a zone; null for anything else."""
    return F.when(text.rlike(_iso), F.try_to_timestamp(text))


def _object(text: str | None) -> dict:
    try:
        out = json.loads(text or "")
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def root_state(claim: str | None, signature: str | None, root_public: bytes | None) -> str:
    """What a root signature is worth."""
    if not signature:
        return "NOT_REQUESTED"
    if root_public is None:
        return "UNVERIFIED_NO_KEY"
    try:
        return "VALID" if verified(root_public, (claim or "").encode(), base64.b64decode(signature)) else "INVALID"
    except ValueError:
        return "INVALID"


def signature_holds(certificate: str | None, public: str | None) -> bool:
    try:
        c = _object(certificate)
        return verified(base64.b64decode(public), signed_part(c), base64.b64decode(c["signature"]))
    except (KeyError, TypeError, ValueError):
        return False


def read_manifests(manifests: DataFrame, manifest: str = "manifest", root_public: bytes | None = None) -> DataFrame:
    """(key_id, manifests): for each key its manifests, as far as they tell something of themselves."""

    @F.pandas_udf(_manifest)
    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for d in map(_object, texts):
            try:
                own = key_id(base64.b64decode(d.get("public_key") or ""))
            except (TypeError, ValueError):
                own = None
            try:
                whole = digest(manifest_fields(d)) == d.get("manifest_hash")
            except (TypeError, ValueError):
                whole = False
            begins, ends = moment(d.get("valid_from")), moment(d.get("valid_until"))
            out.append((d.get("key_id"), d.get("public_key"), begins, ends, d.get("valid_until") is None, own is not None and own == d.get("key_id"), whole, root_state(d.get("manifest_hash"), d.get("root_signature"), root_public)))
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in _manifest.split(", ")])
        for c in ("begins", "ends"):
            frame[c] = pd.to_datetime(frame[c], utc=True)
        return frame

    return manifests.select(read(F.col(manifest)).alias("m")).filter("m.key_id is not null").groupBy("m.key_id").agg(F.array_sort(F.collect_set("m")).alias("manifests"))


def _revoked(at: Column, revocations: dict | None, key: Column, root_public: bytes | None, certificates: DataFrame) -> tuple[DataFrame, Column]:
    """certificates with the earliest revocation of their key as __revoked, and the status; a list has at most attest.MAX_REVOKED keys, so it goes to every task."""
    if revocations is None:
        return certificates, F.lit("NOT_CHECKED")
    if revocation_hash(revocations) != revocations.get("list_hash") or root_state(revocations["list_hash"], revocations.get("root_signature"), root_public) == "INVALID":
        return certificates, F.lit("LIST_INVALID")
    least: dict[str, str] = {}
    for e in revocations["entries"]:
        least[e["key_id"]] = min(least.get(e["key_id"], e["revoked_at"]), e["revoked_at"])
    listed = certificates.sparkSession.createDataFrame(sorted(least.items()), "__key string, __revoked string")
    both = certificates.join(F.broadcast(listed), key == F.col("__key"), "left").drop("__key")
    before = F.coalesce(at < moment_of(F.col("__revoked")), F.lit(False))
    return both, F.when(F.col("__revoked").isNull(), "NOT_REVOKED").when(before, "PREDATES_REVOCATION").otherwise("REVOKED")


def provenance(certificates: DataFrame, manifests: DataFrame, revocations: dict | None = None, root_public: bytes | None = None, skew_s: int = 300, certificate: str = "certificate", manifest: str = "manifest") -> DataFrame:
    """certificates (with one's JSON) with manifest_found, the six checks and overall_valid."""
    skew = F.make_dt_interval(secs=F.lit(skew_s))
    rows = certificates.withColumn("__id", F.get_json_object(certificate, "$.key_id")).withColumn("__at", moment_of(F.get_json_object(certificate, "$.timestamp")))
    known = read_manifests(manifests, manifest, root_public).withColumnRenamed("key_id", "__of")
    both = rows.join(known, F.col("__id") == F.col("__of"), "left")
    at = F.col("__at")
    holds = lambda m: F.coalesce((at >= m["begins"] - skew) & (m["open"] | (at <= m["ends"] + skew)), F.lit(False))
    latest = lambda ms: F.array_max(F.transform(ms, lambda m: F.struct(m["begins"].alias("b"), m.alias("m"))))["m"]
    both = both.withColumn("__m", F.coalesce(latest(F.filter("manifests", holds)), latest(F.col("manifests"))))

    @F.pandas_udf("boolean")
    def holds_signature(texts: pd.Series, publics: pd.Series) -> pd.Series:
        return pd.Series([signature_holds(t, p) for t, p in zip(texts, publics, strict=True)], dtype=bool)

    found = F.col("__m").isNotNull()
    both, revoked = _revoked(at, revocations, F.col("__id"), root_public, both)
    checked = both.select(
        *[F.col(f"`{c}`") for c in certificates.columns], found.alias("manifest_found"),
        F.when(found, holds_signature(F.col(certificate), F.col("__m.public_key"))).alias("signature_valid"), F.when(found, F.col("__m.id_matches")).alias("key_id_matches"),
        F.when(found, holds(F.col("__m"))).alias("within_validity_window"), F.when(found, F.col("__m.hash_consistent")).alias("manifest_hash_consistent"),
        F.col("__m.root").alias("root_signature_status"), revoked.alias("revocation_status"),
    )
    sound = F.col("signature_valid") & F.col("key_id_matches") & F.col("within_validity_window") & F.col("manifest_hash_consistent")
    fine = F.col("root_signature_status").isin("VALID", "NOT_REQUESTED") & F.col("revocation_status").isin("NOT_CHECKED", "NOT_REVOKED", "PREDATES_REVOCATION")
    unknown = sound & (F.col("root_signature_status") == "UNVERIFIED_NO_KEY")
    return checked.withColumn("overall_valid", F.when(F.col("manifest_found") & ~unknown, sound & fine))
