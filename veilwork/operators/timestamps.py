"""RFC 3161 tokens: what they say. Signatures of authorities are not checked, so nothing here is ever called verified."""

from __future__ import annotations

import base64
from datetime import UTC, datetime

# Object identifiers in DER.
SIGNED_DATA = bytes.fromhex("2a864886f70d010702")
TST_INFO = bytes.fromhex("2a864886f70d0109100104")
HASHES = {bytes.fromhex("608648016503040201"): "sha256", bytes.fromhex("608648016503040203"): "sha512"}


def parts(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the values side by side."""
    out, at = [], 0
    while at < len(data):
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4:
                raise ValueError("bad length")
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            raise ValueError("a value is cut short")
        out.append((tag, data[at : at + n]))
        at += n
    return out


def inspect(token_b64: str, digest_hex: str) -> dict:
    """status (UNVERIFIED, MISMATCH or MALFORMED), gen_time, hash_algorithm of a token for a digest."""
    try:
        (_, content), *_ = parts(base64.b64decode(token_b64, validate=True))
        (_, kind), (_, wrapped) = parts(content)[:2]
        if kind != SIGNED_DATA:
            raise ValueError("no signed data")
        signed = parts(parts(wrapped)[0][1])
        (_, what), (_, inner) = parts(signed[2][1])[:2]
        if what != TST_INFO:
            raise ValueError("no timestamp")
        info = parts(parts(parts(inner)[0][1])[0][1])
        algorithm, imprint = parts(info[2][1])
        name = HASHES[parts(algorithm[1])[0][1]]
        stamp = next(v for t, v in info if t == 0x18).decode().rstrip("Z").split(".")[0]
        at = datetime.strptime(stamp, "%Y%m%d%H%M%S").replace(tzinfo=UTC)
        same = imprint[1].hex() == digest_hex.lower()
    except (ValueError, KeyError, IndexError, StopIteration, TypeError) as e:
        return {"status": "MALFORMED", "gen_time": None, "hash_algorithm": None, "reason": type(e).__name__}
    return {"status": "UNVERIFIED" if same else "MISMATCH", "gen_time": at.isoformat(), "hash_algorithm": name, "reason": None}
