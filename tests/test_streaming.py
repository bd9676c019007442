import random
import time
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from veilwork.config import Detect
from veilwork.errors import VeilError
from veilwork.functions.tokens import restore
from veilwork.operators import masking as M
from veilwork.operators.evaluate import coverage, matched, scores
from veilwork.streaming.restore import Restorer, Restoring, passed_stream, restored_stream, stream_records
from veilwork.streaming.sessions import masked_stream
from veilwork.streaming.state import drain

VALUES = {"[email_0]": "a@b.co", "[person_1]": "Ada", "[phone_de_12]": "+49 1 [x]"}
TEXTS = [
    "Write to [EMAIL_0] or [Person_1].", "[[EMAIL_0]] [EMAIL_0", "［EMAIL_0］ and ［x］ [", "no token [a b] here ]", "[PHONE_DE_12][EMAIL_0]",
    "[" * 60 + "EMAIL_0]", "[UNKNOWN_9] [email_0] ［" + "A" * 60 + "］", "",
]


def test_any_cut_equals_the_batch(spark):
    rnd = random.Random(1)
    mapping = F.create_map(*[F.lit(x) for kv in VALUES.items() for x in kv])
    batch = [r[0] for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").select(restore(F.col("t"), mapping)).collect()]
    for text, want in zip(TEXTS, batch, strict=True):
        for k in range(60):
            r, at, out = Restorer(dict(VALUES)), 0, []
            while at < len(text):
                n = len(text) if k == 0 else rnd.randint(1, 4)
                out.append(r.feed(text[at : at + n]))
                at += n
            assert "".join([*out, r.flush()]) == want


def test_cap():
    with pytest.raises(VeilError):
        Restorer({}, cap=3).feed("four")


SCHEMA = "stream_id long, seq long, chunk string, last boolean, tokens map<string,string>"


def left(spark, folder, *names):
    """Rows that the state reader still finds."""
    return sum(spark.read.format("statestore").option("stateVarName", n).load(f"{folder}/state").count() for n in names)


def fed(spark, folder, batches, change, schema, pause=0.0):
    spark.createDataFrame([], schema).write.parquet(folder + "/in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
        out = drain(change(spark.readStream.schema(schema).parquet(folder + "/in")), folder)
        time.sleep(pause)
    return out


def test_streams_end_by_themselves_and_leave_nothing(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    batches = [
        [(1, 2, "[", True, None), (1, 0, "see [EMA", False, {"[EMAIL_0]": "a@b.co"}), (2, 0, "x" * 60, False, {"[EMAIL_0]": "zz"}), (3, 0, "hi [EM", False, {"[EMAIL_0]": "zz"}), (3, 2, "hi", True, None), (None, 0, None, True, None)],
        [(1, 1, "IL_0] bye ", False, None), (1, 0, "see [EMA", False, None), (2, 1, "more", True, None)],
        [(4, 0, "a", True, {})],
    ]
    out = fed(spark, folder, batches, lambda s: restored_stream(s, cap=50, idle=1500), SCHEMA, pause=1.7).orderBy("stream_id", "seq", "is_summary")
    rows = out.collect()
    text = lambda k: "".join(r["chunk"] for r in rows if r["stream_id"] == k)
    assert (text(1), text(2), text(3), text(4), text(None)) == ("see a@b.co bye [", "", "hi [EM", "a", "")
    ends = [(r["stream_id"], r["chars_processed"], r["tokens_restored"], r["tokens_used"], r["stream_error"], r["error_type"]) for r in rows if r["is_summary"]]
    assert ends == [
        (None, 0, 0, [], False, None), (1, 19, 1, ["[EMAIL_0]"], False, None), (2, 60, 0, ["[EMAIL_0]"], True, "StreamTooLong"), (3, 6, 0, ["[EMAIL_0]"], True, "StreamTimeout"), (4, 1, 0, [], False, None),
    ]
    assert left(spark, folder, "turn", "early", "held", "tokens") == 0
    records = {r["key_stream_id"]: r for r in stream_records(out, "m").collect()}
    assert records[3]["metadata"] == '{"stream_error":true,"error_type":"StreamTimeout","chars_processed":6}'
    assert (records[1]["event_type"], records[1]["entity_count"], records[1]["categories"]) == ("desanitize_stream", 1, {"EMAIL": 1})


def test_any_batches_equal_the_whole(spark, tmp_path):
    rnd = random.Random(6)
    mapping = F.create_map(*[F.lit(x) for kv in VALUES.items() for x in kv])
    want = {i: r[0] for i, r in enumerate(spark.createDataFrame([(t,) for t in TEXTS], "t string").select(restore(F.col("t"), mapping)).collect())}
    rows = []
    for i, t in enumerate(TEXTS):
        cuts = [t[a : a + 3] for a in range(0, len(t), 3)] or [""]
        rows += [(i, k, c, k == len(cuts) - 1, VALUES if k == 0 else None) for k, c in enumerate(cuts)]
    rnd.shuffle(rows)
    folder = str(tmp_path / uuid.uuid4().hex)
    out = fed(spark, folder, [rows[:40], rows[40:41], rows[41:]], restored_stream, SCHEMA).filter("not is_summary").orderBy("seq").collect()
    assert {i: "".join(r["chunk"] for r in out if r["stream_id"] == i) for i in want} == want
    assert left(spark, folder, "turn", "early", "held", "tokens") == 0


class Cell:
    """A state that counts how often it is asked."""

    def __init__(self, asked):
        self.asked, self.kept = asked, {}

    def __getattr__(self, name):
        def call(key=(), value=None):
            self.asked.append(name)
            if name in ("update", "updateValue"):
                self.kept[() if name == "update" else key] = key if name == "update" else value
            if name in ("clear", "removeKey"):
                [self.kept.pop(k, None) for k in (list(self.kept) if name == "clear" else [key])]
            return {"get": self.kept.get(()), "exists": bool(self.kept), "getValue": self.kept.get(key), "containsKey": key in self.kept, "keys": iter(list(self.kept)), "iterator": iter(list(self.kept.items()))}.get(name)

        return call


class Handle:
    def __init__(self):
        self.asked, self.timers = [], set()

    def getValueState(self, name, *schemas):
        return Cell(self.asked)

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def getCurrentProcessingTimeInMs(self):
        return 7


def test_state_is_asked_for_once_a_key_not_once_a_row():
    handle, row = Handle(), Row("seq", "chunk", "last", "tokens")
    r = Restoring()
    r.init(handle)
    rows = [row(k, "[EMA" if k % 2 == 0 else "IL_0] ", k == 1999, '[{"key":"[EMAIL_0]","value":"a@b.co"}]' if k == 0 else None) for k in range(2000)]
    first = list(r.handleInputRows((1,), iter(rows[:1000]), Clock()))
    assert len(handle.asked) < 10
    assert handle.timers
    second = list(r.handleInputRows((1,), iter(rows[1000:]), Clock()))
    assert len(handle.asked) < 20
    assert not handle.timers
    assert "".join(x["chunk"] for x in first + second) == "a@b.co " * 1000
    assert not any(c.kept for c in (r.turn, r.early, r.held, r.tokens))


def test_streams_without_tokens_pass_without_state(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    out = fed(spark, folder, [[(1, 0, "［A_1］ [", False, None), (1, 1, None, True, None)]], passed_stream, SCHEMA).orderBy("seq", "is_summary").collect()
    assert [(r["seq"], r["chunk"], r["is_summary"], r["chars_processed"], r["stream_error"]) for r in out] == [(0, "［A_1］ [", False, None, None), (1, "", False, None, None), (1, "", True, 0, False)]
    assert spark.createDataFrame([], SCHEMA).transform(passed_stream).columns == spark.createDataFrame([], SCHEMA).select("stream_id", "seq").columns + [c for c in out[0].asDict() if c not in ("stream_id", "seq")]


def test_streamed_sessions_equal_the_batch(spark, tmp_path):
    rnd = random.Random(2)
    mails = [f"u{i}@example.com" for i in range(5)]
    rows = []
    for conv in range(8):
        n = rnd.randint(1, 6)
        rows += [(conv, t, "user", None if (conv + t) % 9 == 4 else " ".join([rnd.choice(mails) for _ in range(rnd.randint(0, 3))] + ["[EMAIL_0]"]), t == n - 1) for t in range(n)]
    schema = "conv_id long, turn long, role string, text string, last boolean"
    how = Detect(only=("EMAIL",), max_chars=0)
    want, tokens = M.masked_conversations(spark.createDataFrame(rows, schema), how, hint=None)
    want = {(r["conv_id"], r["turn"]): r["text"] for r in want.collect()}
    known = {(r["conv_id"], r["token"], r["key"]) for r in tokens.collect()}
    for k in range(2):
        rnd.shuffle(rows)
        cut = rnd.randint(1, len(rows) - 1)
        folder = str(tmp_path / uuid.uuid4().hex)
        out = fed(spark, folder, [rows[:cut], rows[cut:]], lambda s: masked_stream(s, how, values=True), schema).collect()
        assert {(r["conv_id"], r["turn"]): r["masked"] for r in out} == want, k
        assert {(r["conv_id"], t, v) for r in out for t, v in (r["fresh"] or {}).items()} == known
        assert left(spark, folder, "turn", "early", "tokens", "counts") == 0


def test_idle_sessions_are_forgotten_and_state_has_no_value(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    schema = "conv_id long, turn long, role string, text string"
    how = Detect(only=("EMAIL",), max_chars=0)
    change = lambda s: masked_stream(s, how, secret="k", idle=1000)
    fed(spark, folder, [[(1, 0, "user", "a@example.com")]], change, schema, pause=1.2)
    held = spark.read.format("statestore").option("stateVarName", "tokens").load(f"{folder}/state").collect()
    assert len(held) == 1
    assert "example.com" not in str(held)
    spark.createDataFrame([(2, 0, "user", "b@example.com")], schema).write.mode("append").parquet(folder + "/in")
    drain(change(spark.readStream.schema(schema).parquet(folder + "/in")), folder)
    assert left(spark, folder, "tokens") == 1
    assert "[EMAIL_0]" in str(spark.read.format("statestore").option("stateVarName", "tokens").load(f"{folder}/state").collect())


def test_evaluation(spark):
    span = "array<struct<start:int,end:int,category:string>>"
    rows = [("a", [(0, 10, "E"), (0, 10, "E"), (20, 30, "P")], [(0, 8, "E"), (40, 44, "P")]), ("b", [], [(0, 1, "E")]), ("c", None, None)]
    got = {r["category"]: (r["tp"], r["fp"], r["fn"], r["precision"]) for r in scores(matched(spark.createDataFrame(rows, f"sample string, found {span}, labels {span}")), "category").collect()}
    assert got == {"E": (1, 1, 1, 0.5), "P": (0, 1, 1, 0.0)}
    lab = spark.createDataFrame([(1, 0, 10, "E"), (1, 20, 30, "E"), (2, 0, 4, "P")], "doc_id int, start int, end int, category string")
    found = spark.createDataFrame([(1, 0, 6, "E"), (1, 4, 10, "X"), (1, 22, 23, "E")], "doc_id int, start int, end int, category string")
    assert [(r["state"], round(r["share"], 3), r["right_category"]) for r in coverage(lab, found).orderBy("doc_id", "start").collect()] == [("scrubbed", 1.0, True), ("partial", 0.1, True), ("raw", 0.0, False)]
