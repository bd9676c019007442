"""The table function and the automaton, against columns and loops."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilwork.config import Detect
from veilwork.functions.spans import placed_values
from veilwork.operators import masking as M
from veilwork.sources import table_function
from veilwork.sources.backends import Backend, LanguageModelBackend
from veilwork.sources.literals import Taken, placed

TEXTS = ["mail a@example.com or +49 170 1234567, T-123456", "", None, "no span", "a@b.co a@b.co T-1 4111111111111111", "x" * 5000 + " a@example.com"]


def test_the_table_function_equals_the_columns(spark):
    table_function.register(spark)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    how = Detect(locale="de", custom=(("TICKET", r"T-\d{6}"),), max_chars=0)
    want = sorted(map(tuple, M.entities(M.detected(rows, how), "id").collect()))
    got = spark.sql("SELECT r.id, s.* FROM {rows} r, LATERAL detect_spans(r.text, locale => 'de', custom => :own) s", {"own": r"TICKET=T-\d{6}"}, rows=rows)
    assert sorted(map(tuple, got.collect())) == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT * FROM detect_spans(cast(null as string))").count() == 0


@pytest.mark.parametrize(
    ("call", "said"),
    [
        ("detect_spans(1)", "type int"), ("detect_spans('x', only => 'NOPE')", "unknown categories"), ("detect_spans('x', custom => 'A')", "NAME=regex"),
        ("detect_spans('x', custom => 'AB=(a+)+b')", "too slow"), ("detect_spans('x', custom => 'EMAIL=a')", "reserved"),
    ],
)
def test_what_is_wrong_stops_the_query_at_its_analysis(spark, call, said):
    table_function.register(spark)
    with pytest.raises(Exception, match=said):
        spark.sql(f"SELECT * FROM {call}")


def test_backends_of_the_callers_come_after_the_patterns(spark):
    table_function.register(spark, "detect_more", (LanguageModelBackend(lambda t: [("Ada", "USERNAME"), ("a@example.com", "USERNAME")]),))
    got = spark.sql("SELECT s.category, s.text, s.source FROM detect_more('Ada a@example.com', only => 'EMAIL') s").collect()
    assert [tuple(r) for r in got] == [("USERNAME", "Ada", "llm"), ("EMAIL", "a@example.com", "regex")]


def test_short_and_long_texts_have_the_spans_of_the_columns(spark):
    edge = [" a@example.com".rjust(n, "ä") for n in (table_function.SHORT // 2 + 7, table_function.SHORT // 2 + 8)]  # at the bound, and one letter beyond it
    rows = spark.createDataFrame(list(enumerate([*TEXTS, *edge, "y" * 300_000 + " T-654321 a@b.co"])), "id int, text string")
    want = M.entities(M.detected(rows, Detect(locale="de", custom=(("TICKET", r"T-\d{6}"),), max_chars=0)), "id")
    got = table_function.entities(rows, "id", locale="de", custom=r"TICKET=T-\d{6}")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.columns == want.columns


def test_a_worker_holds_few_texts_at_a_time(spark):
    class Held(Backend):
        name = "held"

        def detect(self, text, covered):
            mb = int(Path("/proc/self/statm").read_text().split()[1]) * 4096 // 1_000_000
            return [{"start": 0, "end": 1, "category": "MB", "text": str(mb), "confidence": 1.0, "source": self.name}]

    def most(n):
        rows = spark.range(0, n, 1, 1).select("id", F.concat(F.lit("x"), F.repeat(F.lit("lorem ipsum "), 1700), F.col("id").cast("string")).alias("text"))
        return table_function.entities(rows, "id", more=(Held(),), only="EMAIL").agg(F.count("*"), F.max(F.expr("try_cast(text as int)"))).head()

    few, many = most(10), most(4000)  # 4,000 texts are 82 MB
    assert (few[0], many[0]) == (10, 4000)
    assert many[1] - few[1] < 40


def test_the_automaton_places_as_the_columns_do(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        text = "".join(rnd.choice("abcß🙂 ") for _ in range(rnd.randint(0, 60)))
        values = [("".join(rnd.choice("abcß🙂") for _ in range(rnd.randint(0, 4))), rnd.choice("XY")) for _ in range(rnd.randint(0, 6))]
        rows.append((i, text, sorted(values)))
    df = spark.createDataFrame(rows, "id int, text string, named array<struct<value:string,category:string>>")
    want = {r["id"]: [(d["start"], d["end"], d["category"], d["text"]) for d in r["s"]] for r in df.select("id", placed_values(F.col("text"), F.col("named"), 0.8).alias("s")).collect()}
    for i, text, values in rows:
        assert placed(text, values) == want[i], (text, values)


def test_the_automaton_is_linear():
    text = "ab " * 200_000
    assert len(placed(text, [(f"v{i}", "X") for i in range(2000)] + [("ab", "Y"), ("b a", "Z")])) == 199_999  # the longer value takes its places first


def test_taken_places():
    t = Taken([(5, 9), (1, 3), (2, 4), (8, 10)])
    assert (t.starts, t.ends) == ([1, 5], [4, 10])
    assert [t.take(*p) for p in ((4, 5), (3, 5), (9, 11), (10, 11), (0, 1), (0, 20))] == [True, False, False, True, True, False]
