"""Quality rules: a table of thresholds compiled into one projection over text metrics, built-in functions only.

Defined results: a null text counts as empty; it has no word, so the base rule rejects it. Repeated rows each get their own
result, an empty table gives an empty one, and columns besides the text are carried along whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm._common import WORD, table, words_of

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it with as was on are be by this at from or an he not but have had "
    "le la les de et des en un une que du est pour dans par sur qui au avec pas "
    "der die das und ist von zu mit sich den nicht ein eine als auch für auf dem im es "
    "el los las y se del con su para al lo como no una por"
).split()
WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high, or if it has fewer than least words."""

    metric: str
    low: float = float("-inf")
    high: float = float("inf")
    least: int = 0


#: The method's thresholds. Ratios are per word, of lines with a word for repeated lines; a stutter is a word equal to the one before.
RULES = (
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbol_ratio", high=0.25),
    Rule("stop_word_ratio", low=0.02, least=40),
    Rule("dup_line_ratio", high=0.6),
    Rule("mean_line_words", low=1.2, least=40),
    Rule("stutter_ratio", high=0.3),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of docs: all of it as the struct `doc`, and the metrics. Nothing is shuffled."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    d = d.select("doc", "t", words_of(F.col("t")).alias("words"), lines.alias("lines"))
    d = d.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))).cast("long").alias("n_stutters"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.transform(F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    rest = ["doc", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_stutters"]
    d = d.select(*rest, F.when(F.col("n_words") > WINDOW, windows).alias("windows"))
    # Few texts have a window twice; only those are sorted.
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select(*rest, F.when(twice, by_hash).alias("sorted"))
    same = lambda x, j: F.coalesce(F.get("sorted", j)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("sorted", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    d = d.select(*rest, starts.alias("starts"))
    gap = F.transform("starts", lambda s, j: F.least(F.lit(WINDOW), s - F.coalesce(F.get("starts", j - 1), F.lit(-WINDOW))))
    covered = F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The base rule and the whole verdict as columns over the metrics."""
    n = F.col("n_words")
    ratio = {
        "mean_word_length": F.col("word_chars") / F.greatest(n, F.lit(1)),
        "symbol_ratio": F.col("n_symbols") / F.greatest(n, F.lit(1)),
        "stop_word_ratio": F.col("n_stop_words") / F.greatest(n, F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "mean_line_words": n / F.greatest(F.col("n_lines"), F.lit(1)),
        "stutter_ratio": F.col("n_stutters") / F.greatest(n, F.lit(1)),
    }
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    passes = [(n < r.least) | ratio[r.metric].between(r.low, r.high) for r in rules]
    return failed, ~failed & reduce(lambda a, b: a & b, passes, F.lit(True))


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics, base_failed and kept for each document, which is kept as the struct `doc`."""
    failed, kept = verdict(rules)
    return measured(docs, text).withColumns({"base_failed": failed, "kept": kept})


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their columns as they were.

    The verdict is exploded from an array of one: a filter on it would else be pushed below the projections, which would then
    compute the metrics once for each use of a use.
    """
    found = quality_rules(docs, text, rules).select("doc", F.explode(F.array("kept")).alias("kept"))
    return found.filter("kept").select("doc.*")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    word = r"'[^\x20\x09-\x0D]+'"
    tests = {
        "mean_word_length": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "mean_line_words": "n_words / greatest(n_lines, 1)",
        "stutter_ratio": "n_stutters / greatest(n_words, 1)",
    }
    bound = lambda r: f"({tests[r.metric]} BETWEEN {r.low if r.low > -1e9 else -1e9} AND {r.high if r.high < 1e9 else 1e9})"
    rules = " AND ".join(f"(n_words < {r.least} OR {bound(r)})" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {word}) AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word})) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range({WINDOW})) AS k) GROUP BY r),
m AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(ws, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
  CAST(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS BIGINT) AS n_stutters,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON w.r = cov.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {rules} AS kept FROM b"""


SQL = _sql()
#: For the pipeline's SQL: the same, of any view.
SQL_OF = lambda view: SQL.replace("FROM documents", f"FROM {view}")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
