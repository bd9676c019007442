"""Byte-pair encoding and decoding with a public vocabulary.

A pre-token is merged with a priority queue of merge ranks over a doubly linked list of symbols; entries whose symbols have
changed since they were queued are stale and skipped. Decoding concatenates vocabulary strings with the file's separator.

Defined results: a null text is an empty one and has no ids. Texts are encoded whole, whatever their length. Repeated rows each
get their own result, an empty table gives an empty one, and other columns are left aside.

The vocabulary is a fixed file of some MB, read on the driver and broadcast. Each worker keeps the ids of the chunks it has met,
and of the pre-tokens in them, the latest met up to CHUNKS and PIECES of them: memory stays bounded whatever the corpus holds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from veilwork.llm._common import table

CHUNKS, PIECES = 600_000, 200_000
#: The white space of the file's patterns; Python's own class also holds \x1c-\x1f.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACE = re.compile("[\x1c-\x1f]")
CHUNK = re.compile(f"[^{SPACE}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [chr(b) if b in shown else "" for b in range(256)]
    spare = iter(range(256, 512))
    return [c or chr(next(spare)) for c in out]


class Latest:
    """Of what was put or got, the latest `most` entries at most and half as many at least."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = max(1, most // 2), {}, {}

    def get(self, key: str) -> bytes | None:
        if (value := self.new.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value


class WordBpe:
    """Of a vocabulary file: white space dropped, lower case, word ends marked by a suffix."""

    def __init__(self, spec: str) -> None:
        parsed = json.loads(spec)
        model = parsed["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.strings = {i: s.encode() for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merge = [self.vocab[a + b] for a, b in merges]
        pattern = next(p["pattern"]["Regex"] for p in parsed["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.inner = [self.vocab.get(c) for c in byte_alphabet()]
        self.final = [self.vocab.get(c + self.suffix) for c in byte_alphabet()]
        self.known, self.known_pieces = Latest(CHUNKS), Latest(PIECES)

    def merged(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        inner = self.inner
        ids = [inner[b] for b in word[:-1]]
        ids.append(self.final[word[-1]])
        if None in ids:  # a byte that the file does not have
            ids = [i for i in ids if i is not None]
        n = len(ids)
        rank, merge, push, pop = self.rank.get, self.merge, heapq.heappush, heapq.heappop
        # after and before link the symbols; -1 closes the list at both ends (ids[n] is also ids[-1]) and stands for a symbol
        # that has been merged, so that no pair with it has a rank. A queue entry is rank * n + place.
        queue = [r * n + i for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        if not queue:
            return ids
        ids.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heapq.heapify(queue)
        while queue:
            r, i = divmod(pop(queue), n)
            j = after[i]
            if rank(ids[i] << 32 | ids[j]) != r:
                continue  # stale: one of its symbols has been merged since
            ids[i] = new = merge[r]
            ids[j] = -1
            after[i] = k = after[j]
            before[k] = i
            if (r := rank(new << 32 | ids[k])) is not None:
                push(queue, r * n + i)
            if (r := rank(ids[h := before[i]] << 32 | new)) is not None:
                push(queue, r * n + h)
        return [i for i in ids if i >= 0]

    def normal(self, text: str) -> str:
        """NFC, then each character lowered by itself; a final sigma is lowered like any other."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def chunk(self, text: str) -> bytes:
        """Ids of a run without white space: no piece reaches over white space, nor does the normal form."""
        out: list[bytes] = []
        known = self.known_pieces
        for piece in self.pieces.findall(self.normal(text)):
            if (ids := known.get(piece)) is None:
                ids = array("I", self.merged(piece.encode())).tobytes()
                if len(piece) <= 64:
                    known.put(piece, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers. Strings of special tokens stand for their ids, as the library has it."""
        out: list[bytes] = []
        known = self.known
        found = self.marks.findall(text) if "<|" in text else []
        for at, segment in enumerate(self.marks.split(text) if found else [text]):
            if at:
                out.append(array("I", [self.special[found[at - 1]]]).tobytes())
            chunks = CHUNK.findall(segment) if ODD_SPACE.search(segment) else segment.split()
            ids = list(map(known.new.get, chunks))
            if None in ids:
                for i, chunk in enumerate(chunks):
                    if ids[i] is None:
                        if (one := known.get(chunk)) is None:
                            one = self.chunk(chunk)
                            if len(chunk) <= 64:
                                known.put(chunk, one)
                        ids[i] = one
            out += ids
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Vocabulary strings side by side in UTF-8, a blank between two: the file names no decoder."""
        return b" ".join(map(self.strings.__getitem__, array("I", ids)))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The text of a public vocabulary file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 for each row; with ids, the ids and the decoded text themselves instead of digests."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, " + ("ids array<long>, decoded string" if ids else "ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(shared.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, first, second = [], [], []
            for value in batch.column(1):
                i = bpe.encode(value.as_py() or "")
                said = bpe.decode(i)
                n.append(len(i) // 4)
                first.append(list(array("I", i)) if ids else sha(i))
                second.append(said.decode() if ids else sha(said))
            firsts = pa.array(first, pa.list_(pa.int64()) if ids else pa.string())
            names = [key, "n_tokens", "ids" if ids else "ids_sha256", "decoded" if ids else "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), firsts, pa.array(second, pa.string())], names)

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary())
