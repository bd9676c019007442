"""Mixing, quality rules: against their SQL and plain loops."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from veilwork.llm import mixing, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, data, name):
    same(spark, data, queries.QUERIES[name], queries.ORACLE_SQL[name])


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, words string, doc string")


ROWS = [
    (1, "a b c", "x", "clash", None), (1, "a b c", "x", "clash", None), (2, None, "x", None, None), (None, "d e", None, None, None), (3, "", "y", None, None),
    (4, " ".join(["w"] * 50), "y", None, None), (5, "one\ntwo\x00three\x0bfour", "z", None, None), (6, "é " * 30, "x", None, None), (None, "d e", None, None, None),
]


def test_mixing_of_odd_rows_equals_sql(spark):
    docs = documents(spark, ROWS)
    con = duckdb.connect()
    pdf = docs.select("doc_id", "text", "source").toPandas()
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    con.register("documents", pdf)
    got = sorted(map(repr, map(tuple, mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect())))
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall()
    assert got == sorted(map(repr, want))


def test_mixing_fills_targets_and_repeats_whole_documents(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 10 else "hot", None, None) for i in range(600)]
    docs = documents(spark, rows)
    out = mixing.mix(docs).join(docs.select(F.col("doc_id"), "source"), "doc_id").collect()
    size = Counter()
    taken, target = Counter(), {}
    for r in out:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] % r["size"] == 0
        assert r["taken"] <= 3 * r["size"]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-9
        assert abs(taken[s] - target[s]) <= 7
    assert sum(taken.values()) <= sum(size.values())
    copies = Counter(r["doc_id"] for r in mixing.mixed(docs).select("doc_id").collect())
    assert copies == {r["doc_id"]: r["copies"] for r in out if r["copies"]}
    assert mixing.mixed(docs).columns == docs.columns


def test_rows_alike_are_taken_one_by_one(spark):
    rows = [(1, "ten words " * 5, "a")] * 50 + [(i, "ten words " * 5, "b") for i in range(100, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 2
    assert all(abs(r["taken"] - r["target"]) <= 10 for r in got)
    out = [r["source"] for r in mixing.mixed(docs).collect()]
    assert 98 <= len(out) <= 100
    assert {s: out.count(s) // 10 for s in "ab"} == {"a": 3, "b": 6}
    firsts = [out[:k].count("a") / k for k in (30, 60, 90)]  # the sources take turns all along
    assert all(0.25 < f < 0.42 for f in firsts)


def test_capped_sources_leave_their_share(spark):
    docs = documents(spark, [(1, "w " * 10, "a", None, None), (2, "w " * 1000, "b", None, None), (3, "w " * 5, "c", None, None)])
    got = {r["doc_id"]: r["target"] for r in mixing.mix(docs).collect()}
    assert got[1] == 30
    assert got[3] == 15
    assert got[2] == 1015 - 45


@pytest.mark.parametrize("operator", [mixing.mix, mixing.mixed, quality_rules.quality_rules, quality_rules.keep_good])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).count() == 0


def repeated(words):
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_quality_metrics_equal_a_loop(spark):
    texts = [
        None, "", "one two", "a b c d e f g h " * 3, "x y " * 40, "line one\nline one\n\n \nline two", "#tag $5 *** || ok", " ".join(str(i % 11) for i in range(60)),
        "the cat and the dog " + " ".join(f"w{i}" for i in range(200)), "tab\tand\x0bvertical\x0cfeed\r\n", "é ü 🙂 " * 9, " ".join(f"u{i}" for i in range(3000)) + " the of and to in a is",
    ]
    docs = documents(spark, [(i, t, None, "clash", "clash") for i, t in enumerate(texts)])
    for r in quality_rules.quality_rules(docs).collect():
        t = texts[r["doc"]["doc_id"]] or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(words)
        assert r["base_failed"] == (len(words) < 20 or 100 * repeated(words) > 30 * len(words))
        assert not (r["kept"] and r["base_failed"])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()] == []  # none has enough function words
    prose = "the house of the man and the dog is in the town with a wall for it as was said on that day " * 1
    clean = documents(spark, [(1, prose + " ".join(f"w{i}" for i in range(20)), None, None, None), (2, (prose + prose.upper()).replace(" ", " ### "), None, None, None)])
    assert [r["doc_id"] for r in quality_rules.keep_good(clean).collect()] == [1]


def test_mixing_and_rules_plan_no_python(spark, data):
    for name in ("op1_mixing", "op2_quality_rules"):
        plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
