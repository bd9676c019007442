"""Rules compiled to columns against the rules run one record at a time, on records made at random."""

import json
import random

from veilwork.operators import audit_schema as S
from veilwork.operators.schema_columns import faults, schema_faults

TEXTS = ["", "a", "a b", "d-1", "x" * 64, "x" * 65, "x" * 257, "é" * 256, "nul\0", "text", "image", "c2pa", "none", "sha256", "abcdef09", "zz", "https://a.b/c", "http://x", "https://x\ny", "QUJD=", "end\n"]
VALUES = [None, True, False, 0, 1, -1, 7, 0.0, 1.0, 2.5, -0.5, 1e20, 10**20, [], {}, ["a"], ["x" * 33], [1], {"a": 1}, {"a": 1.5}, {"a": None}, {"k" * 33: 1}, {str(i): i for i in range(65)}, ["n"] * 33]
EVENTS = ["sanitize", "key_registered", "content_generation", "chain_checkpoint", *sorted(S.BIAS_EVENTS)]


def value(rng, depth=0):
    if depth < 5 and rng.random() < 0.3:
        return {rng.choice("abc"): value(rng, depth + 1) for _ in range(2)} if rng.random() < 0.5 else [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice(TEXTS if rng.random() < 0.5 else VALUES)


def record(rng):
    entry = {"seq": rng.randint(0, 9), "event_type": rng.choice(EVENTS)}
    if rng.random() < 0.1:
        del entry["event_type"]
    for name in ("decision_id", "system_version_pin", "metadata"):
        if rng.random() < 0.4:
            entry[name] = value(rng)
    if rng.random() < 0.3:
        entry["entity_details"] = rng.choice([value(rng), [{rng.choice(["start", "token", "value", "odd", "text"]): 1 for _ in range(3)} for _ in range(2)], [1, {"category": "x"}]])
    if rng.random() < 0.2:
        entry[rng.choice(["odd", "über", "Z", "_"])] = 1
    for part, (events, _, tests) in S.PARTS.items():
        if entry.get("event_type") in events and rng.random() < 0.9 or rng.random() < 0.1:
            entry[part] = {k: value(rng) for k in tests if rng.random() < 0.8} if rng.random() < 0.95 else rng.choice(VALUES)
            if isinstance(entry[part], dict) and rng.random() < 0.3:
                entry[part] |= {rng.choice(["text", "more", "body"]): 1}
    return entry


def test_columns_equal_the_rules(spark):
    rng = random.Random(4)
    entries = [record(rng) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(map(json.dumps, entries))), "n int, line string")
    got = {r["n"]: r["f"] for r in rows.select("n", faults(rows["line"]).alias("f")).collect()}
    bad = [(set(S.violations(e)) ^ set(got[n]), json.dumps(e)) for n, e in enumerate(entries) if sorted(S.violations(e)) != sorted(got[n])]
    assert not bad, (len(bad), *bad[:3])
    assert sum(not f for f in got.values()) > 20 and sum(len(f) > 2 for f in got.values()) > 100


def test_every_test_is_compiled():
    from veilwork.operators.schema_columns import RULES

    assert {t.rule[0] for _, _, tests in S.PARTS.values() for t in tests.values()} | {"text", "like"} == set(RULES)


def test_what_is_no_record(spark):
    lines = ["[]", "1", "{cut", "", None, '{"a": NaN}', "{}"]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    assert [r["f"] for r in rows.select(faults(rows["line"]).alias("f")).collect()] == [None] * 6 + [[]]
    assert schema_faults(rows).count() == 0


def test_no_python_worker(spark):
    rows = spark.createDataFrame([("f", 1, '{"odd": 1}')], "file string, line_no long, line string")
    out = schema_faults(rows)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("f", 1, "odd: unknown field")]
