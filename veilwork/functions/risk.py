"""What a masked text still gives away, as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.spans import SPACE, let
from veilwork.functions.tokens import TOKEN

# Describing words, and phrases that tie one person to another.
DESCRIPTORS = (
    "ceo president founder director chairman chairwoman wife husband daughter son mother father "
    "only tallest youngest oldest first last sole chief head lead senior junior"
).split()
RELATIONS = (
    "married", "divorced", "works at", "employed by", "lives in", "born in", "graduated from", "founded", "owns", "manages",
    "reports to", "hired by", "sister of", "brother of", "daughter of", "son of", "wife of", "husband of",
)
PUNCTUATION = "[.,;:!?\"'()\\[\\]]"
ANY_TOKEN = "(?i)" + TOKEN


def rounded(x: Column) -> Column:
    """To three places, half up."""
    return F.floor(x * 1000 + 0.5) / 1000


def assess(text: Column) -> Column:
    """struct<token_density, identifying_descriptors, relationship_edges, risk_score, risk_level, warnings> of a masked text."""
    lower = F.lower(text)
    has_token = lambda s: s.rlike(ANY_TOKEN)

    def scored(words: Column) -> Column:
        clean = lambda w: F.regexp_replace(w, f"^{PUNCTUATION}+|{PUNCTUATION}+$", "")
        near = lambda i: F.array_join(F.slice(words, F.greatest(i - 4, F.lit(1)), F.lit(11) + F.least(i - 5, F.lit(0))), " ")
        told = F.filter(F.transform(words, lambda w, i: F.when(clean(w).isin(DESCRIPTORS) & has_token(near(i)), clean(w))), lambda w: w.isNotNull())
        ties = F.flatten(F.array(*[_ties(lower, phrase) for phrase in sorted(RELATIONS)]))
        n_tokens = F.size(F.regexp_extract_all(text, F.lit(ANY_TOKEN), F.lit(0)))

        def result(t: Column) -> Column:
            density = n_tokens / F.greatest(F.size(words), F.lit(1))
            score = F.least(F.lit(1.0), density * 1.5 + F.size(t["d"]) * 0.15 + F.size(t["r"]) * 0.2)
            said = F.concat(F.transform(t["d"], lambda w: F.concat(F.lit("Identifying descriptor '"), w, F.lit("' near a token"))), F.transform(t["r"], lambda w: F.concat(F.lit("Relationship '"), w, F.lit("' connects tokens"))))
            level = F.when(score > 0.7, "high").when(score > 0.3, "medium").otherwise("low")
            return F.struct(rounded(density).alias("token_density"), F.size(t["d"]).alias("identifying_descriptors"), F.size(t["r"]).alias("relationship_edges"), rounded(score).alias("risk_score"), level.alias("risk_level"), F.slice(said, 1, 5).alias("warnings"))

        return let(F.struct(told.alias("d"), ties.alias("r")), result)

    # A text without a token gives nothing away by this measure, and its words are not looked at.
    words = F.filter(F.split(lower, f"{SPACE}+"), lambda w: w != "")
    zero = F.struct(F.lit(0.0).alias("token_density"), F.lit(0).alias("identifying_descriptors"), F.lit(0).alias("relationship_edges"), F.lit(0.0).alias("risk_score"), F.lit("low").alias("risk_level"), F.expr("cast(array() as array<string>)").alias("warnings"))
    return F.when(F.coalesce(has_token(lower), F.lit(False)), let(words, scored)).otherwise(zero)


def _ties(lower: Column, phrase: str) -> Column:
    """The phrase once for each place where a token lies within 50 characters on either side."""

    def found(parts: Column) -> Column:
        def there(_: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, p: n + F.length(p)) + i * len(phrase)
            before = F.substring(lower, F.greatest(start - 49, F.lit(1)), F.least(start, F.lit(50)))
            after = F.substring(lower, start + len(phrase) + 1, F.lit(50))
            return F.when(before.rlike(ANY_TOKEN) & after.rlike(ANY_TOKEN), F.lit(phrase))

        return F.filter(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), there), lambda p: p.isNotNull())

    none = F.expr("cast(array() as array<string>)")
    return F.when(F.contains(lower, F.lit(phrase)), let(F.split(lower, phrase, -1), found)).otherwise(none)
