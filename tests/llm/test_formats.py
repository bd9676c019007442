"""Images, archives, chats and the pipeline: exact round trips and brute force."""

import base64
import cProfile
import hashlib
import pstats
import random
import re
import struct
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import corpus_pipeline
from veilwork.llm import bpe, chat_format, media, mixing, quality_rules, secret_scan, simhash, warc, webp
from veilwork.llm._common import shared_dir


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, feature string")


def test_media_round_trip(spark):
    texts = [None, "", "a", "é🙂" * 100, "x" * 191, "x" * 192, "x" * 193, "\x00\x7f", "same", "same"]
    rows = {r["doc_id"]: r for r in media.media_features(frame(spark, texts), media=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert media.from_media(bytes(r["media"])) == want
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert rows[8]["feature"] == rows[9]["feature"]
    assert media.media_features(frame(spark, [])).count() == 0


def test_texts_go_through_the_format(monkeypatch):
    """What the encoder writes uses real prefix codes, back-references, the cache and transforms, and comes back whole."""
    rnd = random.Random(3)
    ways, met, seen = Counter(), Counter(), webp.transformed
    monkeypatch.setattr(webp, "transformed", lambda a: (lambda r: ways.update([r[0]]) or r)(seen(a)))
    read = webp._values
    monkeypatch.setattr(webp, "_values", lambda p, a: met.update({"copies": len(p)}) or read(p, a))
    quick = webp._read_quick
    monkeypatch.setattr(webp, "_read_quick", lambda b, g, t, w, c: met.update({"cache": c > 0, "lengths": len(g[0].lengths) > 1}) or quick(b, g, t, w, c))
    words = ["word" + str(rnd.randrange(400)) for _ in range(3000)]
    ramp = bytes((3 * i + rnd.randrange(2)) & 0xFF for i in range(192 * 40))
    grey = bytes(b for _ in range(64 * 30) for b in [rnd.randrange(256)] * 3)
    tinted = bytes(b for _ in range(64 * 40) for g in [rnd.randrange(256)] for b in (((g - ((g & 128) << 1)) * 13 >> 5) + rnd.randrange(4) & 255, g, ((g - ((g & 128) << 1)) * -21 >> 5) + rnd.randrange(4) & 255))
    texts = [" ".join(words).encode(), b"", b"ab" * 3000, ("the same line of text\n" * 300).encode(), bytes(rnd.randrange(256) for _ in range(20_000)), ramp, grey, tinted]
    down = bytearray(rnd.randrange(256) for _ in range(192))
    for _ in range(60):
        down += bytes((b + rnd.randrange(3)) & 0xFF for b in down[-192:])
    for raw in [*texts, bytes(down)]:
        payload = media.padded(raw)
        stored = media.to_media(payload)
        assert media.from_media(stored) == payload
    assert len(media.to_media(media.padded(texts[0]))) < 0.75 * len(texts[0])
    assert {"none", "green", "colour", "palette", "predict1", "predict2"} <= set(ways)
    assert min(met["copies"], met["cache"], met["lengths"]) > 0


def test_texts_are_grey_images_and_come_back_whole():
    """Each way of the grey layout is taken by some payload; copies that overlap themselves and images of one grey included."""
    rnd = random.Random(5)
    ways = Counter()
    words = " ".join("word" + str(rnd.randrange(900)) for _ in range(2000)).encode()
    ramp = bytes((3 * (i // 7) + rnd.randrange(2)) & 0xFF for i in range(192 * 60))
    rows = bytearray(rnd.randrange(256) for _ in range(192))
    for _ in range(60):
        rows += bytes((b + rnd.randrange(3)) & 0xFF for b in rows[-192:])
    few = bytes(rnd.choice(b"acgt") for _ in range(192 * 40))
    for raw in (words, ramp, bytes(rows), few, b"", b"a" * 20_000, b"abcdefghijk" * 2000, words + words):
        payload = media.padded(raw)
        ways[webp.grey_transformed(np.frombuffer(payload, np.uint8).reshape(-1, 192))[0]] += 1
        assert media.from_media(media.to_media(payload)) == payload
    assert set(ways) == {"green", "predict1", "predict2", "palette"}
    assert next(media.images(media.to_media(media.padded(words)))).shape[1] == webp.GREY_WIDTH


def test_codes_of_every_length():
    """Counts that grow like Fibonacci numbers need all lengths up to the longest."""
    lengths = webp.code_lengths([1, 1, *(int(1.618**k) for k in range(2, 40)), 0, 0, 0, 0])
    assert max(lengths) == 15
    assert sum(2.0**-n for n in lengths if n) == 1
    for alphabet in ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 15] + [0] * 20, lengths + [0] * 6, [1, 0, 2, 3, 0, 0, 0, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 15] + [0] * 30, [8] * 256 + [0] * 24):
        out = webp.BitsOut()
        webp.put_lengths(out, alphabet)
        got = webp.read_code(webp.Bits(out.bytes() + b"\0" * 8), len(alphabet))
        assert got.symbols == sorted((s for s, n in enumerate(alphabet) if n), key=lambda s: (alphabet[s], s))


def test_payloads_beyond_one_image():
    payload = bytes(random.Random(1).randrange(256) for _ in range(192)) * 16500
    stored = media.to_media(payload)
    assert len(list(media.images(stored))) == 2
    assert media.from_media(stored) == payload


def huffman(out, symbols, alphabet):
    """Writes a code for these symbols, lengths as even as can be; returns symbol -> (code, length)."""
    used = sorted(set(symbols)) or [0]
    if len(used) == 1:
        if used[0] < 256:
            webp.put_one(out, used[0])
            return {used[0]: (0, 0)}
        used.append(0)
        used.sort()
    n = (len(used) - 1).bit_length()
    short = (1 << n) - len(used)
    lengths = [0] * alphabet
    for k, s in enumerate(used):
        lengths[s] = n - 1 if k < short else n
    put_any(out, lengths)
    code, table, last = 0, {}, 0
    for s in sorted(used, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        table[s] = (code, lengths[s])
        code, last = code + 1, lengths[s]
    return table


def put_any(out, lengths):
    """Lengths one by one, with a code of four bits for all length symbols."""
    out.put(0, 1)
    out.put(15, 4)
    for s in webp.CODE_LENGTH_ORDER:
        out.put(4 if s < 16 else 0, 3)
    out.put(0, 1)
    for n in lengths:
        webp.put_code(out, n, 4)


def put_pixels(out, tokens, cache_bits=0, main=False):
    """tokens: ('px', argb) | ('copy', length prefix, extra, distance prefix, extra) | ('cache', index)."""
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    green = [t[1] >> 8 & 255 if t[0] == "px" else 256 + t[1] if t[0] == "copy" else 280 + t[1] for t in tokens]
    px = [t[1] for t in tokens if t[0] == "px"]
    codes = [huffman(out, green, 280 + (1 << cache_bits if cache_bits else 0)), *(huffman(out, [p >> s & 255 for p in px], 256) for s in (16, 0, 24)), huffman(out, [t[3] for t in tokens if t[0] == "copy"], 40)]
    for g, t in zip(green, tokens, strict=True):
        webp.put_code(out, *codes[0][g])
        if t[0] == "px":
            for code, s in zip(codes[1:4], (16, 0, 24), strict=True):
                webp.put_code(out, *code[t[1] >> s & 255])
        elif t[0] == "copy":
            n = (t[1] - 2) >> 1 if t[1] >= 4 else 0
            out.put(t[2], n)
            webp.put_code(out, *codes[4][t[3]])
            out.put(t[4], (t[3] - 2) >> 1 if t[3] >= 4 else 0)


def image(width, height, tokens, transforms=(), cache_bits=0):
    out = webp.BitsOut()
    for value, n in ((webp.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    for put in transforms:
        out.put(1, 1)
        put(out)
    out.put(0, 1)
    put_pixels(out, tokens, cache_bits, main=True)
    return webp.container(out.bytes())


def noise(n, seed, colours=None):
    g = np.random.default_rng(seed)
    return [int(x) for x in (g.choice(colours, n) if colours else g.integers(0, 2**32, n))]


def argb(px):
    return webp._join(px.astype(np.int64)).ravel().tolist()


def test_plain_pixels_in_both_ways():
    px = noise(64, 1)
    assert argb(webp.decode(image(8, 8, [("px", p) for p in px]))) == px
    few = noise(64, 2, [0xFF000001, 0xFF000203, 0xFF0405FF])
    assert argb(webp.decode(image(8, 8, [("px", p) for p in few]))) == few


def test_back_references_and_cache():
    a, b, c = 0xFF102030, 0x80405060, 0x00FFFFFF
    # distance prefixes: code 2 is the pixel to the left, code 1 the one above; 121 is one pixel back
    tokens = [("px", a), ("px", b), ("px", c), ("copy", 3, 0, 1, 0), ("px", a), ("copy", 2, 0, 0, 0), ("px", b), ("copy", 1, 0, 13, 120 - 96)]
    got = argb(webp.decode(image(4, 4, tokens[:4] + [("px", a), ("copy", 2, 0, 0, 0), ("px", b), ("copy", 3, 0, 1, 0)][:4])))
    flat = [a, b, c, c, c, c, c, a]
    flat += flat[4:7]
    flat += [b]
    flat += [flat[-1]] * 4
    assert got == flat
    index = lambda p, bits: (webp.HASH * p & 0xFFFFFFFF) >> (32 - bits)
    cached = [("px", a), ("px", b), ("cache", index(a, 6)), ("cache", index(b, 6))]
    assert argb(webp.decode(image(2, 2, cached, cache_bits=6))) == [a, b, a, b]


def test_short_distances_are_the_nearest_pixels():
    near = webp.near_distances()
    assert len(near) == 120
    assert near[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert near[-3:] == [(-7, 7), (8, 6), (8, 7)]


def predicted(out, modes, width, height, mode_of):
    """The forward transform by the definition, pixel by pixel."""
    res = np.zeros_like(out)
    for y in range(height):
        for x in range(width):
            left, top = out[y, x - 1], out[y - 1, x]
            if x == 0 and y == 0:
                p = np.array([255, 0, 0, 0])
            elif y == 0:
                p = left
            elif x == 0:
                p = top
            else:
                tl, tr = out[y - 1, x - 1], out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                m2 = lambda a, b: (a + b) // 2
                full = left + top - tl
                near = top if np.abs(full - left).sum() >= np.abs(full - top).sum() else left
                half = m2(left, top)
                p = [np.array([255, 0, 0, 0]), left, top, tr, tl, m2(m2(left, tr), top), m2(left, tl), m2(left, top), m2(tl, top), m2(top, tr), m2(m2(left, tl), m2(top, tr)), near, np.clip(full, 0, 255), np.clip(half + np.fix((half - tl) / 2).astype(int), 0, 255)][mode_of(y, x)]
            res[y, x] = (out[y, x] - p) & 255
    return res


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height = 9, 6
    px = np.random.default_rng(mode).integers(0, 256, (height, width, 4))
    other = (mode + 5) % 14
    residual = predicted(px, None, width, height, lambda y, x: mode if (x >> 2) % 2 == 0 else other)

    def put(out):
        out.put(0, 2)
        out.put(0, 3)  # blocks of four
        put_pixels(out, [("px", 0xFF000000 | (mode if x % 2 == 0 else other) << 8) for y in range(2) for x in range(3)])

    got = webp.decode(image(width, height, [("px", p) for p in argb(residual)], [put]))
    assert (got == px).all()


def test_cross_colour_subtract_green_and_palette():
    px = np.random.default_rng(3).integers(0, 256, (4, 4, 4))
    signed = lambda v: v - 256 if v > 127 else v
    g2r, g2b, r2b = 200, 17, 90
    coded = px.copy()
    for p in coded.reshape(-1, 4):
        red = p[1]
        p[1] = (red - (signed(g2r) * signed(int(p[2])) >> 5)) & 255
        p[3] = (p[3] - (signed(g2b) * signed(int(p[2])) >> 5) - (signed(r2b) * signed(int(red)) >> 5)) & 255
    green = coded.copy()
    green[..., 1] = (coded[..., 1] - coded[..., 2]) & 255
    green[..., 3] = (coded[..., 3] - coded[..., 2]) & 255

    def cross(out):
        out.put(1, 2)
        out.put(0, 3)
        put_pixels(out, [("px", 0xFF000000 | r2b << 16 | g2b << 8 | g2r)])

    assert (webp.decode(image(4, 4, [("px", p) for p in argb(green)], [cross, lambda out: out.put(2, 2)])) == px).all()
    for n, per in ((2, 8), (4, 4), (16, 2), (20, 1)):
        colours = np.random.default_rng(n).integers(0, 256, (n, 4))
        index = np.random.default_rng(n + 1).integers(0, n, (3, 5))
        across = -(-5 // per)
        packed = [sum(int(index[y, x]) << (8 // per) * (x % per) for x in range(c * per, min(5, (c + 1) * per))) for y in range(3) for c in range(across)]
        deltas = np.diff(colours, axis=0, prepend=np.zeros((1, 4), int)) & 255

        def table(out, n=n, deltas=deltas):
            out.put(3, 2)
            out.put(n - 1, 8)
            put_pixels(out, [("px", p) for p in argb(deltas)])

        got = webp.decode(image(5, 3, [("px", 0xFF000000 | v << 8) for v in packed], [table]))
        assert (got == colours[index]).all()


def test_broken_images_are_refused():
    good = webp.encode(random.Random(1).randbytes(1920))
    for bad in (b"RIFX" + good[4:], good[:12] + b"VP8 " + good[16:], good[:20] + b"\0" + good[21:], good[:-150]):
        with pytest.raises(ValueError):
            webp.decode(bad[:4] + struct.pack("<I", len(bad) - 8) + bad[8:])


PAGES = [
    (1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, "http://c\r\nX: y", "<p>one</p>"), (4, None, None), (5, "http://e", ""), (6, "http://f", "é🙂" * 50),
    (7, "http://g", "\r\n\r\nWARC/1.1\r\n"), (7, "http://g", "\r\n\r\nWARC/1.1\r\n"), (7, "http://h", "other"), (None, "http://n", "null id"), (None, "http://n", "<p>one</p>"),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("dg", F.lit("clash"))
    outs = []
    for _ in range(2):
        out = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"
        warc.write_warc(pages, out, shard_bytes=500, roll_bytes=600)
        outs.append({r["name"]: r["sha256"] for r in spark.read.parquet(out + "/manifest").collect()})
    assert outs[0] == outs[1]
    assert len(outs[0]) > 3
    rows = warc.read_warc(spark, out, payload=True).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        raw = [(h or "").encode() for i, _, h in PAGES if i == r["page_id"]]
        mine = [x for x in raw if base64.b32encode(hashlib.sha1(x).digest()).decode() == r["payload_digest"]]
        assert mine
        assert r["payload_bytes"] == len(mine[0])
        top = max((-1 if i is None else i for i, _, h in PAGES if (h or "").encode() == mine[0]))
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == mine[0]
            assert r["refers_to"] is None
            assert r["page_id"] == (None if top == -1 else top)
        else:
            assert r["refers_to"] == top
    assert sorted((r["page_id"] or -1, r["record_type"]) for r in rows).count((7, "revisit")) == 1
    small = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"
    warc.write_warc(pages, small, least=100)
    assert {r["record_type"] for r in warc.read_warc(spark, small).collect()} == {"response"}
    none = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"
    warc.write_warc(pages.limit(0), none)
    assert warc.read_warc(spark, none).count() == 0


def test_shards_are_even_whatever_the_ids(spark):
    far = [*range(2000), 2**40, -(2**63), 2**63 - 1]
    sized = spark.createDataFrame([(i, 1000) for i in far] + [(None, 1000)], "page_id long, n long")
    bounds = warc._bounds(sized, 50_000)
    shard = lambda i: sum(b <= i for b in bounds)
    sizes = Counter(shard(i) for i in far)
    assert 35 <= len(sizes) <= 45
    assert max(sizes.values()) <= 110
    got = sized.filter("page_id is not null").select("page_id", warc._below(bounds, F.col("page_id")).alias("s")).collect()
    assert all(r["s"] == shard(r["page_id"]) for r in got)
    assert warc._bounds(sized.limit(0), 50_000) == []
    assert warc._bounds(spark.createDataFrame([(7, 1000)] * 300, "page_id long, n long"), 50_000) == []


def test_chat_escapes_reversibly():
    rnd = random.Random(2)
    for _ in range(3000):
        t = "".join(rnd.choice(["<s>", "</s>", "[INST]", "[/INST]", "\\", "l", "b", "<", "[", "a", "s>", "/"]) for _ in range(rnd.randint(0, 9)))
        assert chat_format.unescape(chat_format.escape(t)) == t
        turns = [("user", t), (t, "x"), ("assistant", t)]
        assert chat_format.parse(chat_format.inst_template(turns)) == turns


def test_spans_hold_the_texts_of_the_assistant(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"<b>{k}</s> [INST] \\ text") for k in range(150)] + [(None, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "<"), (2, 0, "assistant", "<")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.formatted(df).collect()}
    for conv, r in got.items():
        want = [x[3] or "" for x in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] or 0, x[3] or "")) if x[2] == "assistant"]
        assert [chat_format.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["spans"]] == want
        assert not r["rewrites_history"]
    digest = {r["conv_id"]: r for r in chat_format.formatted(df, digest=True).collect()}
    assert digest[1]["n_turns"] == 150
    assert digest[2]["loss_chars"] == 2
    assert chat_format.formatted(df.limit(0)).count() == 0


def test_texts_under_other_templates_are_read_as_they_are(spark):
    plain = lambda turns: "".join(f"<{r}>{t}</{r}>\n" for r, t in turns)
    read = lambda said: [(r, t) for r, t in re.findall(r"<(\w+)>(.*?)</\1>\n", said, re.S)]
    rows = spark.createDataFrame([(None, 0, "user", "see \\quad", 1), (None, 1, "assistant", "a \\l [b", 2)], "conv_id long, turn long, role string, text string, formatted int")
    got = chat_format.formatted(rows, plain, digest=True, read=read).head()
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (2, 7, hashlib.sha256(b"a \\l [b").hexdigest())


def test_templates_that_rewrite_history_are_found(spark):
    rewriting = lambda turns: f"{len(turns)}:" + "".join(t for _, t in turns)
    looking_back = lambda turns: "".join(f"({r if k == 0 else turns[0][0]}:{t})" for k, (r, t) in enumerate(turns))
    dropping = lambda turns: "".join(f"<{r}>" + (t if r != "system" else "") for r, t in turns)
    turns = [("user", "a"), ("assistant", "b"), ("system", "c")] * 60
    assert chat_format.rewrites_history(rewriting, turns)
    for template in (looking_back, dropping, chat_format.inst_template):
        assert not chat_format.rewrites_history(template, turns)
        whole, blocks = chat_format.Located(template, block=10**9), chat_format.Located(template, block=3)
        assert [whole.add(t) for t in turns] == [blocks.add(t) for t in turns]
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn int, role string, text string")
    r = chat_format.formatted(df, rewriting).head()
    assert (r["formatted"], r["spans"], r["rewrites_history"]) == ("2:ab", [], True)


def test_templates_that_rewrite_turns_far_back_are_found(spark):
    last = lambda turns: "".join(f"<{r}:{t}>" for r, t in turns[-100:])
    reasons = lambda turns: "".join(f"<{r}:{t if r != 'assistant' or not any(x == 'user' for x, _ in turns[k:]) else ''}>" for k, (r, t) in enumerate(turns))
    for template, turns in ((last, [("user", str(k)) for k in range(150)]), (reasons, [("user", "a"), ("assistant", "b"), *[("tool", str(k)) for k in range(90)], ("user", "c")])):
        assert chat_format.rewrites_history(template, turns)
        assert not chat_format.rewrites_history(template, turns[:90])
        r = chat_format.formatted(spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string"), template).head()
        assert (r["formatted"], r["rewrites_history"]) == (template(turns), True)
    local = chat_format.Located(chat_format.inst_template)
    for k in range(1000):
        local.add(("user", str(k)))
        assert len(local.prefix) <= chat_format.BLOCK + 1


def jaccard_roots(texts):
    """The least id that each text reaches by links of texts whose five-word shingles have a Jaccard similarity of 4/5 at least."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {}
    for i in sorted(sets):
        near = {root[j] for j in root if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
        root[i] = min(near, default=i)
        root |= {j: root[i] for j, r in root.items() if r in near}
    return root


def test_images_are_read_by_many_jumps_at_once():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    payload = " ".join(rnd.choice(words) for _ in range(5000)).encode()[: 192 * 100]
    stored = media.to_media(payload)
    assert media.from_media(stored) == payload
    profile = cProfile.Profile()
    profile.runcall(media.from_media, stored)
    assert pstats.Stats(profile).total_calls < len(payload) / 4  # some 15,000 when each token was followed alone


def odd_payloads():
    rnd = random.Random(12)
    prose = [" ".join("word" + str(rnd.randrange(300)) for _ in range(rnd.choice([3, 40, 200, 900]))).encode() for _ in range(60)]
    ramp = bytes((3 * (i // 7) + rnd.randrange(2)) & 0xFF for i in range(192 * 60))
    rows = bytearray(rnd.randrange(256) for _ in range(192))
    for _ in range(600):
        rows += bytes((b + rnd.randrange(3)) & 0xFF for b in rows[-192:])
    bytes_of = lambda n: bytes(rnd.randrange(256) for _ in range(n))
    tail = bytes_of(32)  # the end of one payload again at the beginning of the next
    odd = [b"", b"a", b"x" * 191, b"x" * 40_000, b"abcdefghijk" * 2000, bytes(range(256)) * 40, bytes_of(20_000), ramp, bytes(rows[: 192 * 60]), bytes(rows), b"acgt" * 700 + bytes(17)]
    odd += [bytes(rnd.choice(b"acgt") for _ in range(5000)), bytes_of(160) + tail, tail + bytes_of(160), b"".join(bytes([v] * 3) for v in bytes_of(3000)), prose[3] * 9, bytes_of(300) * 40, prose[5] * 400]
    return [media.padded(raw) for raw in (*odd[:9], *prose, *odd[9:], *prose[:3])]


def test_many_images_at_once_are_those_one_by_one():
    """Stored bytes and what is read back, whatever images come together; grey, predicted, palettes, colours, long ones, copies across payloads."""
    payloads = odd_payloads()
    alone = [webp.encode(p) for p in payloads]
    ways = Counter(webp.grey_transformed(np.frombuffer(p, np.uint8).reshape(-1, 192))[0] for p in payloads)
    assert set(ways) == {"green", "predict1", "predict2", "palette"}
    assert max(map(len, payloads)) >= webp.LARGE
    assert webp.encode_all(payloads) == alone
    assert webp.encode_all(payloads[::-1]) == alone[::-1]
    assert [webp.encode_all([p])[0] for p in payloads] == alone
    greys = webp.decode_greys(alone)
    assert sum(g is not None for g in greys) > 50
    assert all(g in (None, p) for g, p in zip(greys, payloads, strict=True))
    assert media.from_media_all(media.to_media_all(payloads)) == payloads
    long = b"ab" * media.AT_ONCE  # several images that are small when stored
    assert media.from_media_all(media.to_media_all([payloads[0], long, payloads[1]])) == [payloads[0], long, payloads[1]]
    assert webp.encode_all([]) == webp.decode_greys([]) == []


def test_broken_images_among_others_are_refused():
    good = [webp.encode(p) for p in odd_payloads()[9:30]]
    for bad in (good[4][:-60], good[4][:20] + b"\0" + good[4][21:]):
        with pytest.raises(ValueError):
            webp.decode_greys([*good, bad[:4] + struct.pack("<I", len(bad) - 8) + bad[8:], *good])


class Documents:
    """Hands out the function that media_features runs over batches."""

    schema = StructType().add("doc_id", "long").add("text", "string")

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_texts_share_the_calls_of_numpy():
    """Images of prose are made and read together: some 72 calls a text, 497 when each was made and read alone."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(rnd.randint(2, 9)))
    texts = [" ".join(word() for _ in range(300)) for _ in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    profile = cProfile.Profile()
    (out,) = profile.runcall(lambda: list(media.media_features(Documents())(iter([batch]))))
    assert out.column("payload_sha256").to_pylist() == [hashlib.sha256(media.padded(t.encode())).hexdigest() for t in texts]
    calls = sum(made for name, (_, made, *_) in pstats.Stats(profile).stats.items() if "numpy" in name[0] + name[2])
    assert calls < 100 * len(texts)


def test_pipeline_of_odd_and_no_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("bdlmnrst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    prose = "\n".join(f"The {word()} of {word()} and the {word()} is in {word()} with a {word()} to be {word()}." for _ in range(20))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, prose, "en", None, len(prose)), (2, prose, "en", None, len(prose)), (None, prose + " token = abcdefgh12345", "en", "b", None)]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        out = docs
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, "")
        got = out.collect()
        assert {r["doc_id"] for r in got} <= {None, 2}
        assert bool(got) == bool(docs.head(1))


def test_pipeline_equals_its_stages_by_brute_force(spark, data):
    docs = [r.asDict() for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    one = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    verdicts = {r["doc"]["doc_id"]: r["kept"] for r in quality_rules.quality_rules(one(docs)).collect()}
    good = [d for d in docs if verdicts[d["doc_id"]]]
    root = jaccard_roots({d["doc_id"]: d["text"] for d in good})
    single = [d for d in good if root[d["doc_id"]] == d["doc_id"]]
    net = secret_scan.trained()
    for d, (_, spans, _) in zip(single, list(secret_scan.scan([d["text"] or "" for d in single], net)), strict=True):
        for a, _, b in reversed(spans):
            if not any(x < a < y for x, _, y in spans):
                d["text"] = d["text"][:a] + "[SECRET]" + d["text"][max(y for x, _, y in spans if x < b and y > a) :]
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(one(single)).collect()}
    model = bpe.WordBpe(bpe.vocabulary())
    want = sorted((d["doc_id"], hashlib.sha256(model.encode(d["text"])).hexdigest()) for d in single for _ in range(taken[d["doc_id"]]))
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, data).collect())
    assert got == want


def test_pipeline_keeps_one_of_near_copies_by_jaccard(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = corpus_pipeline.good(spark, docs, data).select("doc_id", "text").collect()
    root = jaccard_roots(dict(good))
    out = corpus_pipeline.single(spark, corpus_pipeline.good(spark, docs, data), data)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(set(root.values()))
    assert any((simhash.fingerprint(dict(good)[i] or "") ^ simhash.fingerprint(dict(good)[r] or "")).bit_count() > 2 for i, r in root.items())


def test_shards_have_several_files_at_production_values(spark, tmp_path):
    """Some 40 MiB of payload: files roll by compressed size within shards, and each shard is one partition."""
    import random

    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(20_000)]
    rows = [(i, "u", " ".join(rnd.choices(words, k=2_000))) for i in range(2_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    warc.write_warc(pages, f"{tmp_path}/out")
    files = spark.read.schema(warc.MANIFEST).parquet(f"{tmp_path}/out/manifest").collect()
    by_shard = {}
    for f in files:
        by_shard.setdefault(f["shard"], []).append(f["bytes"])
    assert len(by_shard) == 3
    assert all(len(sizes) > 1 and max(sizes) <= warc.SHARD_BYTES // warc.ROLL_SHARE for sizes in by_shard.values())
    attempts = {f["temporary"].split("/")[1] for f in files}
    assert len(attempts) == 3
    back = warc.read_warc(spark, f"{tmp_path}/out").groupBy("record_type").count().collect()
    assert [tuple(r) for r in back] == [("response", 2_000)]
