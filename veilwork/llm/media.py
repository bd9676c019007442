"""Media columns: payloads stored as lossless WebP images and read back as pixels.

Images are written and read by the whole format (see webp): prefix codes of their own, back-references, cache and transforms.

Defined results: a null text is an empty payload, padded to 192 blanks. A payload beyond one image's rows is stored as several
images, one after the other. Rows alike each get their own result, an empty table gives an empty one, other columns are left aside.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilwork.llm import webp
from veilwork.llm._common import table

UNIT = webp.WIDTH * 3
AT_ONCE = UNIT * webp.MOST_ROWS


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def to_media(payload: bytes) -> bytes:
    return b"".join(webp.encode(payload[at : at + AT_ONCE]) for at in range(0, len(payload), AT_ONCE))


def images(media: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(media):
        n = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        yield webp.decode(media[at : at + n])
        at += n


def from_media(media: bytes) -> bytes:
    """The samples: of grey images one a pixel, of others three."""
    return b"".join((px[..., 2] if px.shape[1] == webp.GREY_WIDTH else px[..., 1:]).tobytes() for px in images(media))


def to_media_all(payloads: list[bytes]) -> list[bytes]:
    """to_media of each; images are made together."""
    images = iter(webp.encode_all([p for p in payloads if len(p) <= AT_ONCE]))
    return [next(images) if len(p) <= AT_ONCE else to_media(p) for p in payloads]


def from_media_all(stored: list[bytes]) -> list[bytes]:
    """from_media of each; grey images that are alone are read together."""
    alone = [len(m) == 8 + struct.unpack("<I", m[4:8])[0] for m in stored]
    greys = iter(webp.decode_greys([m for m, one in zip(stored, alone, strict=True) if one]))
    read = [next(greys) if one else None for one in alone]
    return [from_media(m) if back is None else back for m, back in zip(stored, read, strict=True)]


def _few(values: pa.Array) -> Iterator[list[bytes]]:
    """Texts in UTF-8, as many at a time as are worked on together, so that memory is bounded."""
    few, held = [], 0
    for value in values:
        few.append((value.as_py() or "").encode())
        held += len(few[-1])
        if held >= AT_ONCE:
            yield few
            few, held = [], 0
    if few:
        yield few


def feature(payload: bytes) -> str:
    """Mean of the samples, and 64 bits: which of as many stretches are brighter than the mean."""
    samples = np.frombuffer(payload, np.uint8)
    starts = np.arange(64) * len(samples) // 64
    sums = np.add.reduceat(samples, starts, dtype=np.int64)
    total = int(sums.sum())
    sizes = np.diff(starts, append=len(samples))
    bright = np.packbits(sums * len(samples) > total * sizes).tobytes().hex()
    return f"{total * 100 // len(samples)}:{bright}"


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text", media: bool = False) -> DataFrame:
    """Sizes, digests and the feature for each row; with media also the stored bytes."""
    kind = docs.schema[key].dataType.simpleString()
    fields = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")] + [("media", "binary")] * media
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for few in _few(batch.column(1)):
                images = to_media_all([padded(raw) for raw in few])
                for raw, stored, back in zip(few, images, from_media_all(images), strict=True):
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back), *[stored] * media))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, *(n for n, _ in fields)])

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} {t}" for n, t in fields))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
