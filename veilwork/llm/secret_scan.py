"""Secret scans: three fixed patterns, and a character convolutional network over every other candidate.

A candidate is any run of 16 or more of [A-Za-z0-9+/_=-] that no pattern has found, with or without digits. The network reads it
whole, with CONTEXT characters on either side; a run of more than PIECE characters is read in overlapping pieces, and the greatest
score of a piece is that of the run, so memory is bounded for runs of any length. Characters become classes, one layer of filters of
width 5 is pooled (greatest and mean) over the run and its surroundings, and two dense layers follow. It is trained in numpy, with a
fixed seed, on labelled findings made by a generator of keys and of look-alikes (words, paths, times, UUIDs, commits, checksums).
Scores are calibrated on findings held out of the fit (Platt scaling), and the threshold is the greatest at which the recall of yet
others is RECALL at least. Nothing else bounds it.

Defined results: a null text is an empty one without spans. Texts are read whole. Spans are in code points. Rows alike each get
their own result, an empty table gives an empty one. secret_scan leaves other columns aside, redacted carries them along.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilwork.llm._common import table

CONTEXT = 24
RECALL = 0.96
PIECE = 256
AT_ONCE = 1024
KINDS = ("assign", "access", "hex", "net")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_names = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
_assign = re.compile(rf"""({_names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so shorter ones may as well not match
_run = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_run_chars = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end), by start, then kind."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


def candidates(text: str, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """Runs that no span (in order of start) touches, of whatever characters; both lists are gone through once."""
    at, covered = 0, 0
    for m in _run.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            covered = max(covered, spans[at][2])
            at += 1
        if covered <= m.start():
            yield m.start(), m.end()


def pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
    """What the network reads of a run at once: all of it, or stretches of PIECE that overlap by half."""
    if end - start <= PIECE:
        yield start, end
        return
    for at in range(start, end - PIECE // 2, PIECE // 2):
        yield at, min(end, at + PIECE)


# The network

_classes = np.full(128, 1, np.int8)
for _n, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\"'`:=,.;()[]{}<>/+-_@#&?%$!*|\\~^"):
    _classes[ord(_c)] = _n + 3
N_CLASSES = int(_classes.max()) + 1
OTHER, NO_CHAR = 2, 0
WIDTH, FILTERS, HIDDEN = 5, 32, 16


def window(text: str, start: int, end: int) -> tuple[np.ndarray, int, int]:
    """Classes of the candidate and its context, and where the candidate lies in them."""
    a, b = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    codes = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _classes[np.minimum(codes, 127)], np.int8(OTHER)), start - a, end - a


def batch_of(windows: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, padded; masks of the candidate and of the context."""
    n = max(len(w[0]) for w in windows) + WIDTH - 1
    x = np.zeros((len(windows), n), np.int64)
    inside = np.zeros((len(windows), n - WIDTH + 1), bool)
    near = np.zeros_like(inside)
    for i, (classes, a, b) in enumerate(windows):
        x[i, WIDTH // 2 : WIDTH // 2 + len(classes)] = classes
        near[i, : len(classes)] = True
        inside[i, a:b] = True
    return x, inside, near & ~inside


class Net:
    def __init__(self, seed: int = 7) -> None:
        g = np.random.default_rng(seed)
        self.p = {
            "w": g.normal(0, 0.15, (WIDTH, N_CLASSES, FILTERS)), "b": np.zeros(FILTERS),
            "u": g.normal(0, 0.15, (3 * FILTERS + 1, HIDDEN)), "c": np.zeros(HIDDEN),
            "v": g.normal(0, 0.3, (HIDDEN, 1)), "d": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray, inside: np.ndarray, near: np.ndarray):
        p, n = self.p, inside.shape[1]
        z = sum(p["w"][k][x[:, k : k + n]] for k in range(WIDTH)) + p["b"]
        h = np.maximum(z, 0)
        size = np.maximum(inside.sum(1), 1)[:, None]
        within = np.where(inside[..., None], h, 0)
        around = np.where(near[..., None], h, 0)
        top, top_near = within.argmax(1), around.argmax(1)
        take = lambda a, i: np.take_along_axis(a, i[:, None], 1)[:, 0]
        f = np.concatenate([take(within, top), within.sum(1) / size, take(around, top_near), np.log(size) / 4], 1)
        g = np.tanh(f @ p["u"] + p["c"])
        return (g @ p["v"] + p["d"])[:, 0], (z, top, top_near, size, f, g)

    def step(self, x, inside, near, y, state: dict, rate: float) -> None:
        out, (z, top, top_near, size, f, g) = self.forward(x, inside, near)
        p, n, rows = self.p, inside.shape[1], np.arange(len(y))[:, None]
        e = ((1 / (1 + np.exp(-out))) - y)[:, None] / len(y)
        grad = {"v": g.T @ e, "d": e.sum(0)}
        dg = e @ p["v"].T * (1 - g * g)
        grad |= {"u": f.T @ dg, "c": dg.sum(0)}
        df = dg @ p["u"].T
        dz = np.where(inside[..., None], df[:, None, FILTERS : 2 * FILTERS] / size[:, None], 0)
        each = np.arange(FILTERS)[None, :]
        dz[rows, top, each] += df[:, :FILTERS] * inside[rows, top]
        dz[rows, top_near, each] += df[:, 2 * FILTERS : 3 * FILTERS] * near[rows, top_near]
        dz *= z > 0
        grad["b"] = dz.sum((0, 1))
        flat, of_class = dz.reshape(-1, FILTERS), (x[..., None] == np.arange(N_CLASSES)).astype(float)
        grad["w"] = np.stack([of_class[:, k : k + n].reshape(-1, N_CLASSES).T @ flat for k in range(WIDTH)])
        t = state["t"] = state.get("t", 0) + 1
        for k, d in grad.items():
            m = state[f"m{k}"] = 0.9 * state.get(f"m{k}", 0) + 0.1 * d
            s = state[f"s{k}"] = 0.99 * state.get(f"s{k}", 0) + 0.01 * d * d
            p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)

    def probabilities(self, windows: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
        """Calibrated, for each window; windows of like lengths are scored together."""
        out = np.zeros(len(windows))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(windows):
            by_size.setdefault(max(6, (len(w[0]) - 1).bit_length()), []).append(i)
        for bits, rows in by_size.items():
            at_once = max(1, (1 << 16) >> bits)
            for k in range(0, len(rows), at_once):
                part = rows[k : k + at_once]
                out[part] = self.forward(*batch_of([windows[i] for i in part]))[0]
        return 1 / (1 + np.exp(-(self.scale * out + self.shift)))


def labelled_findings(n: int, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): keys as tools issue them, and runs that only look alike, in prose and code."""
    r = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    mixed = lower + lower.upper() + digits
    word = lambda: some(lower, 2, 9)
    prose = lambda k: " ".join(word() for _ in range(k))
    said = lambda k: "".join(some("bcdfghklmnprstvw", 1, 1 + (r.random() < 0.25)) + some("aeiou", 1, 1 + (r.random() < 0.15)) for _ in range(k)) + r.choice(["", "n", "s", "t", "r"])
    many = lambda a, b: [said(r.randint(1, 4)) for _ in range(r.randint(a, b))]
    keys = (
        lambda: some(mixed, 20, 64), lambda: some(mixed + "+/", 24, 88) + r.choice(["", "=", "=="]),
        lambda: r.choice(["sk_live_", "pk_test_", "ghp_", "gho_", "glpat-", "xoxb-", "npm_", "hf_", "AIza", "SG_"]) + some(mixed, 20, 40),
        lambda: "eyJ" + some(mixed + "_-", 30, 120), lambda: some(digits + "ABCDEF", 32, 64), lambda: some(lower + digits, 24, 48),
        lambda: some(digits + "abcdef", 20, 31), lambda: some(lower + lower.upper(), 16, 40), lambda: some(lower + lower.upper(), 16, 24), lambda: some(mixed, 16, 24),
    )
    alike = (
        lambda: "-".join(word() for _ in range(r.randint(3, 6))) + "-" + some(digits, 1, 4), lambda: "/".join(["", *(word() for _ in range(r.randint(3, 6)))]) + some(digits, 1, 4),
        lambda: f"20{some(digits, 2, 2)}-{some(digits, 2, 2)}-{some(digits, 2, 2)}T{some(digits, 2, 2)}-{some(digits, 2, 2)}-{some(digits, 2, 2)}Z", lambda: "_".join([r.choice(["IMG", "file", "backup", "report", "scan"]), some(digits, 8, 8), some(digits, 6, 6)]),
        lambda: word() + word() + word() + word()[:3] + some(digits, 1, 4), lambda: word().capitalize() + word().capitalize() + word().capitalize() + word().capitalize() + some(digits, 1, 2), lambda: (word()[:2] + some(digits, 1, 1)) * r.randint(6, 12),
        lambda: "a" * r.randint(8, 30) + some(digits, 8, 12), lambda: "=" * r.randint(8, 40) + word() + some(digits, 1, 3) + "=" * r.randint(4, 8), lambda: "-".join([some(digits, 3, 3), some(digits, 1, 1), some(digits, 2, 4), some(digits, 4, 6), "x" + some(digits, 1, 1)]),
        lambda: said(r.randint(7, 13)), lambda: said(r.randint(7, 13)).capitalize(), lambda: said(r.randint(7, 13)).upper(), lambda: some(lower + lower.upper(), 1, 1) * r.randint(16, 60), lambda: r.choice("-=_+/") * r.randint(16, 80), lambda: some(digits, 16, 24), *[lambda: some(digits, 16, 16)] * 2,
        lambda: r.choice("-_/").join(many(4, 8)), lambda: "".join(w.capitalize() for w in many(3, 6)), lambda: "_".join(many(3, 6)).upper(), lambda: said(2) + "".join(w.capitalize() for w in many(3, 5)),
        lambda: "-".join(some(digits + "abcdef", n, n) for n in (8, 4, 4, 4, 12)), lambda: "-".join(some(digits + "abcdef", n, n) for n in (8, 4, 4, 4, 12)).upper(),
        lambda: "-".join([some(digits, 4, 4)] * 3) + "-" + word(), lambda: "v" + "-".join(some(digits, 1, 3) for _ in range(6)) + "-release",
    )
    # Digests and ids that only the word before them tells from keys.
    named_hashes = [(w, lambda: some(digits + "abcdef", 16, 40)) for w in ("commit", "merge", "sha1", "md5", "etag", "checksum", "build", "rev", "digest")]
    named_hashes += [(w, lambda: some(mixed + "+/", 27, 43) + "=") for w in ("integrity", "sha256", "checksum", "digest")] + [(w, lambda: some(digits + "ABCDEF", 16, 40)) for w in ("serial", "crc", "fingerprint")]
    out = []
    for i in range(n):
        label = i % 2
        named = None if label or r.random() > 0.15 else r.choice(named_hashes)
        run = named[1]() if named else r.choice(keys if label else alike)()
        if len(run) < 16:
            run = some(mixed, 20, 40) if label else "-".join(word() for _ in range(5)) + "-in-between"
        if named:
            before = prose(r.randint(0, 4)) + r.choice(["\n", " "]) + named[0] + r.choice([" ", ": ", "=", ' = "', " (", ":"])
        elif r.random() < (0.5 if label else 0.25):
            before = prose(r.randint(0, 4)) + r.choice(["\n", " "]) + r.choice(["key", "auth", "bearer", "credential", "client_id", "signature", "private", "access", "id", "name", "path", "ref"]) + r.choice([": ", "=", ' = "', " ", "='"])
        else:
            before = prose(r.randint(0, 6)) + r.choice([" ", "\n", ""])
        after = r.choice(['"', "'", " ", "\n", "", ". ", ", "]) + prose(r.randint(0, 5))
        if before and before[-1] in _run_chars:
            before += " "
        if after and after[0] in _run_chars:
            after = " " + after
        out.append((before + run + after, len(before), len(before) + len(run), label))
    return out


@functools.cache
def trained(findings: int = 6000, rounds: int = 9) -> Net:
    """A network fitted to three fifths of the findings, calibrated on a fifth; the threshold comes from the last fifth."""
    made = labelled_findings(findings)
    windows, y = [window(t, a, b) for t, a, b, _ in made], np.array([k for *_, k in made], float)
    cut, more = findings * 3 // 5, findings * 4 // 5
    net, state, g = Net(), {}, np.random.default_rng(5)
    for k in range(rounds):
        order = g.permutation(cut)
        for at in range(0, cut, 64):
            rows = order[at : at + 64]
            net.step(*batch_of([windows[i] for i in rows]), y[rows], state, 0.012 * 0.75**k)
    held, labels = windows[cut:more], y[cut:more]
    raw = np.concatenate([net.forward(*batch_of(held[i : i + 256]))[0] for i in range(0, len(held), 256)])
    for _ in range(200):  # Newton steps with a little shrinkage
        q = 1 / (1 + np.exp(-(net.scale * raw + net.shift)))
        s = q * (1 - q) + 1e-6
        grad = np.array([((q - labels) * raw).sum() + 0.1 * (net.scale - 1), (q - labels).sum() + 0.1 * net.shift])
        hess = np.array([[(s * raw * raw).sum() + 0.1, (s * raw).sum()], [(s * raw).sum(), s.sum() + 0.1]])
        net.scale, net.shift = np.array([net.scale, net.shift]) - 0.5 * np.linalg.solve(hess, grad)
    q = np.sort(net.probabilities(windows[more:])[y[more:] == 1])
    net.threshold = float(q[int((1 - RECALL) * len(q))])
    return net


def scan(texts: list[str], net: Net) -> Iterator[tuple[list[Span], list[Span], int]]:
    """For each text its base spans, all spans, and how many base spans the network would have taken too. It reads them all."""
    base = [base_spans(t) for t in texts]
    best: dict[tuple[int, int, int, int], float] = {}  # of a run or base span the greatest score of its pieces
    held: list[tuple[tuple[int, int, int, int], int, int]] = []

    def read() -> None:
        for (of, _, _), q in zip(held, net.probabilities([window(texts[of[0]], a, b) for of, a, b in held]), strict=True):
            best[of] = max(best.get(of, 0.0), float(q))
        held.clear()

    for i, t in enumerate(texts):
        for spans in (base[i], ((a, 3, b) for a, b in candidates(t, base[i]))):
            for a, k, b in spans:
                for x, y in pieces(a, b):
                    held.append(((i, a, k, b), x, y))
                    if len(held) >= AT_ONCE:
                        read()
    if held:
        read()
    more: dict[int, list[Span]] = {}
    confirmed: dict[int, int] = {}
    for (i, a, k, b), q in best.items():
        if q >= net.threshold and k == 3:
            more.setdefault(i, []).append((a, 3, b))
        elif q >= net.threshold:
            confirmed[i] = confirmed.get(i, 0) + 1
    for i, spans in enumerate(base):
        yield spans, sorted(spans + more.get(i, [])), confirmed.get(i, 0)


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans and n_confirmed (base spans that the network takes too) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans, every, confirmed in scan([v or "" for v in batch.column(1).to_pylist()], shared.value):
                kinds = [k for _, k, _ in spans]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(said(spans).encode()).hexdigest(), said(every), confirmed))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True))], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with each span (overlapping ones together) replaced by the mark; length, if there is such a column, follows. A null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    schema, at = docs.schema, docs.columns.index(text)
    counted = docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = {}
            for i, (_, spans, _) in enumerate(scan([t or "" for t in texts], shared.value)):
                if not spans:
                    continue
                parts, end = [], 0
                for a, _, b in spans:
                    if a >= end:
                        parts += [texts[i][end:a], mark]
                    end = max(end, b)
                changed[i] = "".join([*parts, texts[i][end:]])
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type))
                if counted is not None:
                    sizes = batch.column(counted).to_pylist()
                    batch = batch.set_column(counted, batch.schema.field(counted), pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(sizes)], batch.schema.field(counted).type))
            yield batch

    return docs.mapInArrow(run, schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
