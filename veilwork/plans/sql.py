"""DuckDB SQL for the queries, written from the same pattern tables.

RE2 has neither lookarounds nor back-references, so only patterns without them appear in SQL.
"""

from __future__ import annotations

from collections.abc import Iterable

from veilwork.functions.patterns import Pattern


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans_sql(patterns: Iterable[Pattern], view: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    """CTEs that end in `spans` (keys, start, end, category, text): each pattern's matches that overlap none of an earlier one."""
    keys_of = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    same = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM d.{k.strip()}" for k in keys.split(","))
    ctes, before = [], None
    for n, p in enumerate(patterns):
        regex = q(p.regex)
        ctes.append(f"""m{n} AS (SELECT {keys}, regexp_extract_all({text}, {regex}) AS m, string_split_regex({text}, {regex}) AS s FROM {view}
  WHERE regexp_matches({text}, {regex})),
c{n} AS (SELECT {keys}, m[i] AS said, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS place_
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{n})),
d{n} AS (SELECT {keys}, place_ AS "start", CAST(place_ + length(said) AS INT) AS "end", {q(p.category)} AS category, said AS text FROM c{n})""")
        if before is None:
            ctes.append(f"a{n} AS (SELECT * FROM d{n})")
        else:
            ctes.append(f"""a{n} AS (SELECT * FROM {before} UNION ALL SELECT {keys_of("d")}, d."start", d."end", d.category, d.text FROM d{n} d
  WHERE NOT EXISTS (SELECT 1 FROM {before} a WHERE {same} AND d."start" < a."end" AND d."end" > a."start"))""")
        before = f"a{n}"
    return "WITH " + ",\n".join(ctes) + f",\nspans AS (SELECT * FROM {before})"


TOKEN = r"\[([A-Z][A-Z0-9_]*_(?:[0-9]+|REDACTED))\]"


def masked_sql(spans_with_token: str = "pieces", keys: str = "doc_id", view: str = "documents") -> str:
    """CTE `masked` (keys, masked) from pieces (keys, start, end, token): the escaped text with the pieces put in."""
    same = " AND ".join(f"p.{k.strip()} IS NOT DISTINCT FROM t.{k.strip()}" for k in keys.split(","))
    order = keys
    return f"""
texts AS (SELECT {keys}, regexp_replace(text, '{TOKEN}', '［\\1］', 'g') AS e FROM {view}),
gaps AS (SELECT {", ".join("t." + k.strip() for k in keys.split(","))}, t.e, p."start" AS b, p."end" AS f, p.token,
  coalesce(lag(p."end") OVER (PARTITION BY {", ".join("t." + k.strip() for k in keys.split(","))} ORDER BY p."start"), 0) AS a FROM texts t JOIN {spans_with_token} p ON {same}),
put AS (SELECT {keys}, string_agg(substr(e, a + 1, b - a) || token, '' ORDER BY b) || substr(any_value(e), max(f) + 1) AS masked FROM gaps GROUP BY {order}),
masked AS (SELECT {", ".join("t." + k.strip() for k in keys.split(","))}, coalesce(p.masked, t.e) AS masked FROM texts t LEFT JOIN put p ON {same})"""
