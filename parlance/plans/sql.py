"""Shared pieces of the comparison SQL (DuckDB), written from the rules rather than from the plans."""

from __future__ import annotations

from parlance.functions import vocabulary as V
from parlance.sources.adapters import PRODUCTS_SQL


def words(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOP = words(V.STOPWORDS)
CHROME = words(V.CHROME)


def normalise(e: str) -> str:
    return f"lower(trim(regexp_replace({e}, '\\s+', ' ', 'g')))"


def match_text(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'))"


def terms(e: str) -> str:
    return f"list_filter(regexp_extract_all(lower({e}), '[a-z0-9]+'), lambda t: len(t) > 1 AND NOT list_contains({STOP}, t))"


def content_terms(e: str) -> str:
    return f"list_filter({terms(e)}, lambda t: NOT list_contains({CHROME}, t))"


def has(e: str, values) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(e, v.replace("'", "''")) for v in values) + ")"


def route(e: str) -> str:
    low = f"lower({e})"
    parts = [f"WHEN contains({low}, 'budget') OR regexp_matches({low}, '{V.BUDGET_PATTERN}') THEN 'budget'"]
    parts += [f"WHEN {has(low, w)} THEN '{n}'" for n, w in V.ROUTES]
    return f"(CASE {' '.join(parts)} ELSE 'feature' END)"


def price(e: str) -> str:
    n = "[0-9]+(?:\\.[0-9]+)?"
    p = (
        f"coalesce(try_cast({e} AS DOUBLE), try_cast(nullif(regexp_extract({e}, '\\$\\s*({n})', 1), '') AS DOUBLE), "
        f"try_cast(nullif(regexp_extract({e}, '({n})', 1), '') AS DOUBLE))"
    )
    return f"(CASE WHEN {p} > 0 THEN {p} END)"


def kind(e: str) -> str:
    low = normalise(e)
    named = f"trim(regexp_replace({low}, '^color:', ''))"
    return (
        f"(CASE WHEN starts_with({low}, 'color:') AND {named} IN {_in(V.COLORS)} THEN 'color' WHEN {low} IN {_in(V.MATERIALS)} THEN 'material' "
        f"WHEN {low} IN {_in(V.COLORS)} THEN 'color' WHEN contains({low}, 'budget') AND {price(low)} IS NOT NULL THEN 'budget' ELSE 'phrase' END)"
    )


def kind_value(e: str) -> str:
    low = normalise(e)
    named = f"trim(regexp_replace({low}, '^color:', ''))"
    return (
        f"(CASE WHEN starts_with({low}, 'color:') AND {named} IN {_in(V.COLORS)} THEN {named} WHEN {low} IN {_in(V.MATERIALS + V.COLORS)} THEN {low} "
        f"WHEN contains({low}, 'budget') AND {price(low)} IS NOT NULL THEN {price(low)}::VARCHAR END)"
    )


def _in(values) -> str:
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


FIELD = {
    "title": "coalesce(title, '')", "categories": "array_to_string(categories, ' ')", "features": "array_to_string(features, ' ')",
    "details": "plain", "store": "coalesce(store, '')", "description": "array_to_string(description, ' ')",
}
_ORDER = ("title", "features", "details", "description", "categories", "store")
BLOB = match_text(
    "array_to_string(list_filter([" + ", ".join(FIELD[n] for n in _ORDER) + "], lambda s: s <> ''), ' ')"
)
CANON = [c for c in V.COLORS if c != "grey"]
CLEAN = (
    "list_filter(list_transform(flatten(list_transform(categories, lambda v: string_split(v, ','))), lambda p: trim(p)), "
    f"lambda p: p <> '' AND NOT list_contains({words(V.ROOT_CATEGORIES)}, lower(p)))"
)
CATEGORY = f"(CASE WHEN len({CLEAN}) > 0 THEN array_to_string({CLEAN}[-2:], ' ') ELSE '{V.NO_CATEGORY}' END)"

#: product -> idx: what ranking reads of each product.
INDEX = f"""{PRODUCTS_SQL},
flat AS (SELECT *, {BLOB} AS blob, {CATEGORY} AS category FROM product),
split AS (SELECT *, string_split(blob, ' ') AS w FROM flat),
idx AS (SELECT parent_asin, title, blob, category,
  list_filter({words(V.MATERIALS)}, lambda m: list_contains(w, m)) AS materials,
  list_filter(w, lambda x: list_contains({words(V.MATERIALS)}, x))[1] AS first_material,
  list_filter({words(CANON)}, lambda c: list_contains(w, c) OR (c = 'gray' AND list_contains(w, 'grey'))) AS colors,
  replace(list_filter(w, lambda x: list_contains({words(V.COLORS)}, x))[1], 'grey', 'gray') AS first_color,
  {price("price")}::FLOAT::DOUBLE AS price, average_rating::FLOAT::DOUBLE AS rating, rating_number,
  {terms("title")} AS title_terms FROM split)"""

POPULARITY = (
    f"{INDEX},\npop AS (SELECT *, 0.65 * ln(1 + rating_number::DOUBLE) / "
    "coalesce(nullif(ln(1 + (SELECT max(rating_number) FROM idx)::DOUBLE), 0), 1) + 0.35 * rating / 5.0 AS popularity FROM idx)"
)

#: product -> post, len, stat, voc: the weighted index.
POSTINGS = f"""{PRODUCTS_SQL},
post AS (SELECT parent_asin AS doc, token, sum(w)::DOUBLE AS wtf FROM (
  {" UNION ALL ".join(f"SELECT parent_asin, {float(w)} AS w, unnest({terms(FIELD[n])}) AS token FROM product" for n, w in V.FIELD_WEIGHTS)}
) GROUP BY ALL),
len AS (SELECT parent_asin AS doc, coalesce(sum(wtf), 0)::DOUBLE AS len FROM product LEFT JOIN post ON doc = parent_asin GROUP BY 1),
stat AS (SELECT count(*) AS n, avg(len) AS avg_len FROM len),
voc AS (SELECT token, count(*) AS df, ln(1 + ((SELECT n FROM stat) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY 1)"""

CORPUS = f"""
post AS (SELECT doc_id AS doc, token, count(*)::DOUBLE AS wtf FROM (SELECT doc_id, unnest({terms("text")}) AS token FROM documents) GROUP BY ALL),
len AS (SELECT doc_id AS doc, coalesce(sum(wtf), 0)::DOUBLE AS len FROM documents LEFT JOIN post ON doc = doc_id GROUP BY doc_id),
stat AS (SELECT count(*) AS n, avg(len) AS avg_len FROM len),
voc AS (SELECT token, count(*) AS df, ln(1 + ((SELECT n FROM stat) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY 1)"""


def bm25(asked: str, b: float = V.BM25_B, k1: float = V.BM25_K1) -> str:
    """scored(query, doc, score) from ``asked(query, token, boost)``."""
    return (
        f"scored AS (SELECT query, doc, sum(idf * boost * wtf * {k1 + 1} / (wtf + {k1} * ({1 - b} + {b} * len / (SELECT avg_len FROM stat)))) "
        f"AS score FROM {asked} JOIN voc USING (token) JOIN post USING (token) JOIN len USING (doc) WHERE boost <> 0 GROUP BY ALL)"
    )


PASSAGE_TERMS = f"asked AS (SELECT DISTINCT item_id AS query, unnest({terms('text')}) AS token, 1.0::DOUBLE AS boost FROM benchmark)"
