"""Building blocks of the DuckDB statements that the queries are held against."""

from __future__ import annotations

SPACES = r"\s"
LF2 = "chr(10) || chr(10)"


def rr(x: str, pattern: str, by: str = "") -> str:
    pattern, by = pattern.replace("'", "''"), by.replace("'", "''")
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def strip(x: str) -> str:
    return rr(x, r"^\s+|\s+$")


def collapse(x: str) -> str:
    return strip(rr(x, r"\s+", " "))


def line_feeds(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def no_soft_hyphen(x: str) -> str:
    return f"replace({x}, chr(173), '')"


def normalised(x: str) -> str:
    return strip(rr(rr(rr(no_soft_hyphen(line_feeds(x)), r"[ \t]+", " "), " *\n *", "\n"), "\n{3,}", "\n\n"))


def marked_sentences(x: str) -> str:
    pattern = "([.!?]+[\"”’')\\]]*)\\s+([A-ZÇĞİÖŞÜ0-9\"“‘(])"
    return f"string_split({rr(x, pattern, chr(92) + '1' + chr(30) + chr(92) + '2')}, chr(30))"


def masks(abbreviations: tuple[str, ...]) -> list[tuple[str, str]]:
    """Abbreviations, longest first, with the token that hides each from the end marks."""
    return [(a, f"__ABBR_{k}__") for k, a in enumerate(sorted(abbreviations, key=len, reverse=True), 1)]


def masked(x: str, masks: list[tuple[str, str]], back: bool = False) -> str:
    for a, token in masks:
        x = f"replace({x}, '{token}', '{a}')" if back else f"replace({x}, '{a}', '{token}')"
    return x


def heading(x: str, share: float = 0.80) -> str:
    letters, upper = f"length({rr(x, '[^' + chr(92) + 'p{L}]')})", f"length({rr(x, '[^' + chr(92) + 'p{Lu}]')})"
    return f"(length({x}) <= 80 AND {letters} > 0 AND {upper} / greatest({letters}, 1)::DOUBLE > {share})"


def greedy(name: str, units: str, limit: int, gap: int, least: int | None = None) -> str:
    """CTEs `name`_r and `name`: chunk number of each unit of `units` (k, i from 1, t, force, pe)."""
    longer = f"r.held + CASE WHEN r.held > 0 THEN {gap} ELSE 0 END + length(u.t)"
    opens = f"(r.held > 0 AND ({longer} > {limit} OR u.force))"
    held = f"CASE WHEN {opens} THEN length(u.t) ELSE {longer} END"
    closes = f"(u.pe AND {held} >= {least})" if least is not None else "FALSE"
    return f"""{name}_r AS (
  SELECT k, 0::BIGINT AS i, 0 AS c, 0 AS nc, 0::BIGINT AS held FROM {units} WHERE i = 1
  UNION ALL
  SELECT r.k, u.i, r.nc + {opens}::INT, r.nc + {opens}::INT + {closes}::INT,
         CASE WHEN {closes} THEN 0 WHEN u.pe THEN {held} + 2 ELSE {held} END
  FROM {name}_r r JOIN {units} u ON u.k = r.k AND u.i = r.i + 1),
{name} AS (SELECT r.k, r.i, r.c, u.t, u.pe FROM {name}_r r JOIN {units} u ON u.k = r.k AND u.i = r.i WHERE r.i > 0)"""


def word_units(name: str, parts: str, limit: int, cut: bool = False) -> str:
    """CTE `name`: units of parts (k, p, t): whole within the limit, else word by word after a forced cut."""
    words = f"list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')"
    if cut:
        words = f"flatten(list_transform({words}, lambda w: list_transform(range(0, length(w), {limit}), lambda s: w[s + 1 : s + {limit}])))"
    return f"""{name} AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY p, j) AS i, t, force, FALSE AS pe FROM (
    SELECT k, p, 1 AS j, t, FALSE AS force FROM {parts} WHERE t <> '' AND length(t) <= {limit}
    UNION ALL
    SELECT k, p, j, w[j] AS t, j = 1 AS force FROM (SELECT k, p, {words} AS w FROM {parts} WHERE length(t) > {limit}), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS j)))"""
