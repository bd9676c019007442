"""HyperMinHash, importance resampling and ball k-means: against their SQL on odd rows, brute force and plain loops."""

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.oracle import rows_of
from veilwork.llm import ball_kmeans, hyperminhash, near_copies, resampling

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(6_000))  # SQL slices lists in quadratic time


def equal_to_sql(out, sql, **tables):
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(name, pdf)
    want = con.execute(sql).df()
    got = out.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.astype(object).where(got.notna(), None)) == rows_of(want.astype(object).where(want.notna(), None))


def documents(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    pdf = pd.DataFrame(rows, columns=["doc_id", "text"])
    pdf["doc_id"], pdf["text"] = pdf["doc_id"].astype("Int64"), pdf["text"].astype("string")
    return docs, pdf


ODD = [
    (5, None), (6, ""), (7, " \n\t"), (8, "one two"), (3, "ONE two"), (9, "one two three four five"), (None, "one two three four five"), (9, "one two three four five"), (1, LONG), (2, LONG + " more"),
    (4, "a b c d e a b c d e a b c d e"), (10, "a b c d e a b c d e"), (11, "é ü 中文 x y"), (None, None), (12, "É ü 中文 x y"), (13, "one\x0btwo"),
]


def test_hyperminhash_of_odd_rows_equals_sql(spark):
    docs, pdf = documents(spark, ODD)
    out = hyperminhash.near_duplicates(docs).selectExpr("*", "doc_id <=> component_id as kept")
    equal_to_sql(out, hyperminhash.SQL, documents=pdf)
    assert hyperminhash.near_duplicates(docs.limit(0)).count() == 0


def test_hyperminhash_of_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    docs, _ = documents(spark, [(1, long), (2, long + " more"), (3, "w0 " + "x" * 3_000_000), (4, "one")])
    got = [tuple(r) for r in hyperminhash.near_duplicates(docs).orderBy("doc_id").collect()]
    assert got == [(1, 399_996, 1), (2, 399_997, 1), (3, 1, 3), (4, 1, 4)]


def families(seed, groups, members):
    """Texts with more or fewer words changed, around several bases."""
    rnd = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rnd.randint(0, 400)}" for _ in range(rnd.choice([6, 9, 20, 60, 300]))]
        for _ in range(members):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                text[rnd.randrange(len(text))] = f"new{rnd.randint(0, 60)}"
            out.append(" ".join(text))
    rnd.shuffle(out)
    return out


def by_brute_force(texts, percent=85):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("paired", [32, 4])
def test_hyperminhash_equals_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(near_copies, "PAIRED", paired)
    monkeypatch.setattr(hyperminhash, "PAIRED", paired)
    texts = families(3, 9, 45)
    docs, _ = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in hyperminhash.near_duplicates(docs).collect()}
    roots, sizes = by_brute_force(texts)
    assert [got[i] for i in range(len(texts))] == list(zip(roots, sizes, strict=True))


def test_a_crowd_that_shares_bands_makes_few_pairs(spark, monkeypatch):
    """Copies with changes of their own are too far from one another, yet share bands with a third of all."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(600):
        text = list(base)
        for j in range(4):
            text[(i * 7 + j * 50 + rnd.randint(0, 40)) % 200] = f"own{i}x{j}"
        texts.append(" ".join(text))
    monkeypatch.setattr(near_copies, "PAIRED", 8)
    monkeypatch.setattr(hyperminhash, "PAIRED", 8)
    compared, whole = [], near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, *a: (compared.append(pairs.count()), whole(pairs, *a))[1])
    docs, _ = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(docs).collect()}
    roots, _ = by_brute_force(texts)
    assert [got[i] for i in range(len(texts))] == roots
    assert sum(compared) < 20 * len(texts)


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for n, m, both in ((7, 8, 7), (60, 66, 55), (400, 400, 200), (3000, 3200, 2900)):
        agree = []
        for _ in range(300):
            u = rng.integers(-(2**63), 2**63 - 1, n + m - both, dtype=np.int64)
            agree.append((hyperminhash.registers(np.sort(u[:n])) == hyperminhash.registers(np.sort(u[n - both :]))).sum())
        assert abs(hyperminhash.estimate(np.array(agree), float(n), float(m)).mean() - both / (n + m - both)) < 0.01


def test_a_register_holds_zeros_and_the_bits_after_them():
    for h in np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 200, dtype=np.int64):
        whole = f"{int(near_copies.mixed(np.array([h]).view(np.uint64) ^ hyperminhash._salt)[0]):064b}"
        rest = whole[7:]
        zeros = len(rest) - len(rest.lstrip("0"))
        want = zeros << 10 | int(rest[zeros + 1 : zeros + 11].ljust(10, "0"), 2)
        assert set(hyperminhash.registers(np.array([h])).tolist()) == {want}


def test_matched_gives_hot_keys_their_rows(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(2 + i, i) for i in range(2000)], "k long, v long")
    right = spark.createDataFrame([(1, "hot"), (3, "three")], "k long, name string")
    out = Counter(r["name"] for r in hyperminhash.matched(left, right, "k").collect())
    assert out == {"hot": 3000, "three": 1, None: 1999}


def test_resampling_of_odd_rows_equals_sql(spark):
    rows = [*ODD, *[(20 + i % 40, t) for i, t in enumerate(families(5, 5, 12))], (70, "A" * 5000), (71, "x\x00y -- 1,2;3 ÀÉ ß ſ K"), (72, "-- !!")]
    docs, pdf = documents(spark, rows)
    target, other = documents(spark, [(1, "one two three g0w1"), (2, None), (3, "w1x1 W2X2 é")])
    out = resampling.resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
    equal_to_sql(out, resampling.SQL, documents=pdf, benchmark=other)
    assert resampling.resampled(docs.limit(0), target).count() == 0
    none = resampling.resampled(docs, target.limit(0)).filter("rank is not null").count()
    assert none == docs.filter("size(split(text, ' ')) >= 20").count() * 10 // 100


@pytest.mark.parametrize(("size", "nodes"), [(1, 200_000), (3, 200_000), (3, 5)])
def test_tries_count_and_weigh_every_run_of_words(size, nodes):
    rnd = random.Random(size)
    texts = [[f"w{rnd.randint(0, 9)}".encode() for _ in range(rnd.randint(0, 60))] for _ in range(40)]
    features = [[b" ".join(t[i : i + k]) for i in range(len(t)) for k in range(1, size + 1) if i + k <= len(t)] for t in texts]
    want = Counter(crc32(f) % 97 for fs in features for f in fs)
    trie = resampling.Trie(size, 97, nodes=nodes)
    for t in texts:
        trie.count(t)
    trie.flush()
    assert {b: n for b, n in enumerate(trie.totals.tolist()) if n} == want
    gain = np.arange(97) - 40
    trie = resampling.Trie(size, 97, gain, nodes=nodes)
    for t, fs in zip(texts, features, strict=True):
        assert trie.weigh(t) == (len(fs), sum(int(gain[crc32(f) % 97]) for f in fs))


def test_gains_are_floors_of_log_ratios(spark):
    s, t = spark.createDataFrame([(0, 5), (2, 1)], "bucket long, n long"), spark.createDataFrame([(0, 1), (1, 4)], "bucket long, n long")
    want = [math.floor(1000 * math.log((b + 1) * (6 + 3) / ((a + 1) * (5 + 3)))) for a, b in ((5, 1), (0, 4), (1, 0))]
    assert resampling.gains(s, t, 3).tolist() == want


def vectors(spark, rows, width):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, v int, cluster int")
    pdf = pd.DataFrame({"vec_id": pd.array([i for i, _ in rows], "Int64"), "embedding": pd.Series([None if v is None else [None if x is None else float(np.float32(x)) for x in v] for _, v in rows], dtype=object)})
    return table, pdf


def test_balls_of_odd_rows_equal_sql(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(i % 5, 0.4) for _ in range(64)]) for i in range(150)]
    rows += [(None, rows[0][1]), (0, rows[0][1]), (0, rows[7][1]), (200, None), (201, [0.0] * 63), (202, [0.0] * 63 + [None]), (203, [float("nan")] + [0.0] * 63), (204, [float("inf")] * 64), (205, [1e9] * 64), (206, [-200_000.0] * 64)]
    table, pdf = vectors(spark, rows, 64)
    con = duckdb.connect()
    con.register("raw", pdf)
    equal_to_sql(ball_kmeans.clustered(table)[0], ball_kmeans.SQL.replace("from embeddings", "from (select vec_id, cast(embedding as float[]) as embedding from raw)"), raw=pdf)
    assert ball_kmeans.clustered(table.limit(0))[0].count() == 0
    few, _ = vectors(spark, rows[:3], 64)
    assert sorted(r["distance"] for r in ball_kmeans.clustered(few)[0].collect()) == [0, 0, 0]


def test_balls_equal_plain_rounds(spark):
    rnd = np.random.default_rng(9)
    points = [(i, rnd.integers(-2, 3, 3).astype(float).tolist()) for i in range(400)]  # many equal distances
    table, _ = vectors(spark, points, 3)
    got, centroids = ball_kmeans.clustered(table, width=3, k=7, rounds=4)
    x = np.floor(256 * np.array([p for _, p in points])).astype(np.int64)
    import hashlib

    start = sorted(range(400), key=lambda i: (hashlib.sha256(f"2:{i}".encode()).hexdigest(), points[i][1]))[:7]
    c = x[start]
    for turn in range(5):
        best = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if turn < 4:
            c = np.stack([np.array([int(s) // int((best == k).sum()) for s in x[best == k].sum(0)]) if (best == k).any() else c[k] for k in range(7)])
    assert centroids.tolist() == c.tolist()
    assert {r["vec_id"]: r["cluster"] for r in got.collect()} == dict(enumerate(best.tolist()))


def test_balls_compare_few_centroids():
    rng = np.random.default_rng(3)
    c = rng.integers(-3000, 3000, (40, 16))
    owner = rng.integers(0, 40, 5000)
    x = c[owner] + rng.integers(-300, 300, (5000, 16))
    balls = ball_kmeans.Balls(c)
    moved = np.where(rng.random(5000) < 0.02, rng.integers(0, 40, 5000), owner)
    best, far = balls.reassigned(x, moved)
    plain = ((x[:, None] - c[None]) ** 2).sum(2)
    assert best.tolist() == plain.argmin(1).tolist()
    assert far.tolist() == plain.min(1).tolist()
    assert balls.compared < 5000 * 39 // 10
    groups = defaultdict(int)
    for b in best.tolist():
        groups[b] += 1
    assert len(groups) == 40
