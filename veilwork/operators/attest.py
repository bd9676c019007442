"""Attestation: Merkle trees over tables, certificates, key manifests, revocation and provenance."""

from __future__ import annotations

import base64
import json
import os
import re
import secrets
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.errors import ConfigError
from veilwork.functions.canonical import canonical, digest
from veilwork.functions.ed25519 import Keys, b64, key_id
from veilwork.operators.ranking import ranked
from veilwork.operators.report import manifest_fields

# Merkle trees


def numbered(rows: DataFrame, order: str, hash_: str) -> DataFrame:
    """(idx, hash): rows numbered in order."""
    return ranked(rows.select(order, hash_), [], [order, hash_], "idx").select("idx", F.col(hash_).alias("hash"))


def pair(left: Column, right: Column) -> Column:
    """Hash of two nodes' hex hashes; a node without a partner goes up as it is."""
    return F.when(right.isNull(), left).otherwise(F.sha2(F.concat(left, right), 256))


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """leaves (idx, hash) -> the levels (idx, hash) from the leaves to the root; each is half of the one below."""
    levels, n = [leaves], leaves.count()
    while n > 1:
        side = lambda k: F.max(F.when(F.col("idx") % 2 == k, F.col("hash")))  # noqa: B023,E731
        up = levels[-1].groupBy(F.floor(F.col("idx") / 2).alias("i")).agg(side(0).alias("l"), side(1).alias("r"))
        levels.append(up.select(F.col("i").alias("idx"), pair(F.col("l"), F.col("r")).alias("hash")))
        n = -(-n // 2)
    return levels


def merkle_root(leaves: DataFrame) -> str | None:
    row = merkle_levels(leaves)[-1].head()
    return row["hash"] if row else None


def merkle_proofs(leaves: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(leaf, hash, proof): for each wanted leaf (all by default) the partners on its way up with their side."""
    levels = merkle_levels(leaves)
    paths = leaves if wanted is None else leaves.join(wanted.select("idx"), "idx", "left_semi")
    paths = paths.select(F.col("idx").alias("leaf"), "hash", F.col("idx").alias("at"), F.expr("cast(array() as array<struct<hash:string,side:string>>)").alias("proof"))
    for level in levels[:-1]:
        partner = level.select(F.col("idx").alias("partner"), F.col("hash").alias("other"))
        step = paths.join(partner, F.col("at").bitwiseXOR(F.lit(1).cast("long")) == F.col("partner"), "left")
        side = F.when(F.col("at") % 2 == 0, "right").otherwise("left")
        more = F.when(F.col("other").isNull(), F.col("proof")).otherwise(F.concat("proof", F.array(F.struct(F.col("other").alias("hash"), side.alias("side")))))
        paths = step.select("leaf", "hash", F.floor(F.col("at") / 2).alias("at"), more.alias("proof"))
    return paths.select("leaf", "hash", "proof")


def proven_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's proof leads to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.when(s["side"] == "left", F.concat(s["hash"], h)).otherwise(F.concat(h, s["hash"])), 256))


# Certificates

SIGNED = ("version", "timestamp", "input_hash", "output_hash", "entity_count", "categories", "detection_passes", "mode", "key_id", "nonce")


def signed_part(certificate: dict) -> bytes:
    return canonical({k: certificate.get(k) for k in SIGNED}).encode()


def certify(keys: Keys, private: bytes, public: bytes, input_hash: str, output_hash: str, entity_count: int, categories: dict, passes: list[str], mode: str, now: datetime | None = None) -> dict:
    """One certificate for a text, or for a batch by the Merkle roots of its texts."""
    out = {"version": "1.0", "timestamp": (now or datetime.now(UTC)).isoformat(), "input_hash": input_hash, "output_hash": output_hash, "entity_count": entity_count, "categories": categories, "detection_passes": passes, "mode": mode, "key_id": key_id(public), "nonce": secrets.token_hex(16)}
    return out | {"signature": b64(keys.sign(private, signed_part(out))), "public_key": b64(public)}


def certificate_valid(keys: Keys, certificate: dict, public: bytes | None = None) -> bool:
    try:
        own = public or base64.b64decode(certificate["public_key"])
        return keys.verify(own, signed_part(certificate), base64.b64decode(certificate["signature"]))
    except (KeyError, ValueError):
        return False


def save_keys(path: str, private: bytes, public: bytes) -> None:
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC | os.O_NOFOLLOW, 0o600)
    with os.fdopen(handle, "w") as f:
        json.dump({"key_id": key_id(public), "private_key": b64(private), "public_key": b64(public)}, f)
    os.chmod(path, 0o600)


def load_keys(path: str) -> tuple[bytes, bytes]:
    d = json.loads(Path(path).read_text())
    return base64.b64decode(d["private_key"]), base64.b64decode(d["public_key"])


# Key manifests and revocation

PURPOSES = ("audit_signing", "certificate_signing", "root_signing")
_iso = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)")
MAX_REVOKED = 4096


def moment(text: str | None) -> datetime | None:
    """Null if it is no time with a zone."""
    if not isinstance(text, str) or not _iso.fullmatch(text):
        return None
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None


def derive_manifest(public: bytes, deployer: str, valid_from: str, valid_until: str | None = None, purpose: str = "audit_signing", sign_root: Callable[[bytes], bytes] | None = None, root_key_id: str | None = None) -> dict:
    if not deployer or len(deployer) > 256:
        raise ConfigError("deployer_id must have 1 to 256 characters")
    if moment(valid_from) is None or (valid_until is not None and (moment(valid_until) is None or moment(valid_until) <= moment(valid_from))):
        raise ConfigError("validity must be given by times with a zone, the end after the beginning")
    if (sign_root is None) != (root_key_id is None):
        raise ConfigError("a root signature needs a root key id, and the other way round")
    out = {"key_id": key_id(public), "public_key": b64(public), "deployer_id": deployer, "valid_from": valid_from, "valid_until": valid_until, "purpose": purpose, "manifest_version": "1.0", "root_key_id": root_key_id}
    out["manifest_hash"] = digest(manifest_fields(out))
    out["root_signature"] = b64(sign_root(out["manifest_hash"].encode())) if sign_root else None
    return out


def revocation_hash(listing: dict) -> str:
    """In the order of the entries."""
    return digest({k: listing.get(k) for k in ("deployer_id", "entries", "issued_at", "list_version", "root_key_id")})


def derive_revocations(deployer: str, entries: list[dict], issued_at: str, before: dict | None = None, sign_root: Callable[[bytes], bytes] | None = None, root_key_id: str | None = None) -> dict:
    """Revocation is for good: the entries of the list before stay, each key is revoked once."""
    every = [*(before or {}).get("entries", []), *entries]
    ids = [e["key_id"] for e in every]
    if len(ids) != len(set(ids)):
        raise ConfigError("a key is revoked twice")
    if len(every) > MAX_REVOKED:
        raise ConfigError(f"more than {MAX_REVOKED} revoked keys")
    if any(moment(e["revoked_at"]) is None for e in every) or moment(issued_at) is None:
        raise ConfigError("times need a zone")
    out = {"deployer_id": deployer, "entries": every, "issued_at": issued_at, "list_version": "1.0", "root_key_id": root_key_id}
    out["list_hash"] = revocation_hash(out)
    out["root_signature"] = b64(sign_root(out["list_hash"].encode())) if sign_root else None
    return out


def find_revocation(listing: dict, key: str) -> dict | None:
    """The earliest of a key."""
    return min((e for e in listing["entries"] if e["key_id"] == key), key=lambda e: e["revoked_at"], default=None)


def root_status(keys: Keys, claim: str, signature: str | None, root_public: bytes | None) -> str:
    if not signature:
        return "NOT_REQUESTED"
    if root_public is None:
        return "UNVERIFIED_NO_KEY"
    try:
        return "VALID" if keys.verify(root_public, claim.encode(), base64.b64decode(signature)) else "INVALID"
    except ValueError:
        return "INVALID"


def revocation_status(keys: Keys, listing: dict | None, key: str, at: str, root_public: bytes | None = None) -> str:
    """A list that is not intact proves nothing; a time that cannot be read counts as after."""
    if listing is None:
        return "NOT_CHECKED"
    if revocation_hash(listing) != listing.get("list_hash") or root_status(keys, listing["list_hash"], listing.get("root_signature"), root_public) == "INVALID":
        return "LIST_INVALID"
    if (e := find_revocation(listing, key)) is None:
        return "NOT_REVOKED"
    signed, revoked = moment(at), moment(e["revoked_at"])
    return "PREDATES_REVOCATION" if signed is not None and revoked is not None and signed < revoked else "REVOKED"


def provenance(keys: Keys, certificate: dict, manifest: dict, revocations: dict | None = None, root_public: bytes | None = None, skew_s: int = 300) -> dict:
    """Six checks of a certificate against its key's manifest."""
    at, begins, ends = moment(certificate.get("timestamp")), moment(manifest.get("valid_from")), moment(manifest.get("valid_until"))
    skew = timedelta(seconds=skew_s)
    public = base64.b64decode(manifest["public_key"])
    within = at is not None and begins is not None and at >= begins - skew and (manifest.get("valid_until") is None or (ends is not None and at <= ends + skew))
    out = {
        "signature_valid": certificate_valid(keys, certificate, public),
        "key_id_matches": certificate.get("key_id") == manifest.get("key_id") == key_id(public),
        "within_validity_window": within,
        "manifest_hash_consistent": digest(manifest_fields(manifest)) == manifest.get("manifest_hash"),
        "root_signature_status": root_status(keys, manifest.get("manifest_hash", ""), manifest.get("root_signature"), root_public),
        "revocation_status": revocation_status(keys, revocations, manifest["key_id"], certificate.get("timestamp", ""), root_public),
    }
    sound = all(out[k] for k in ("signature_valid", "key_id_matches", "within_validity_window", "manifest_hash_consistent"))
    fine = out["root_signature_status"] in ("VALID", "NOT_REQUESTED") and out["revocation_status"] in ("NOT_CHECKED", "NOT_REVOKED", "PREDATES_REVOCATION")
    unknown = out["root_signature_status"] == "UNVERIFIED_NO_KEY"
    out["overall_valid"] = (sound and fine) if not (sound and unknown) else None
    return out
