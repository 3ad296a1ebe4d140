"""Scoring and ranking of candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.config import Config
from parlance.functions import text as T
from parlance.sources.shared import checkpointed

CONSTRAINT = "array<struct<text:string,kind:string,value:string,weight:double>>"


def typed(texts: Column, weight: float = 1.0) -> Column:
    """An array of texts as constraints with kind, value and weight."""

    def one(c: Column) -> Column:
        k = T.classify_kind(c)
        return F.struct(c.alias("text"), k["kind"].alias("kind"), k["value"].alias("value"), F.lit(weight).alias("weight"))

    return F.transform(texts, one)


def satisfies_material(value: Column, first: Column, all_of: Column) -> Column:
    return F.when(first == value, 1.0).when(F.array_contains(all_of, value), 0.6).otherwise(0.0)


def satisfies_color(value: Column, first: Column, all_of: Column) -> Column:
    gray = F.when(value == "grey", F.lit("gray")).otherwise(value)
    return satisfies_material(gray, first, all_of)


def satisfies_budget(value: Column, price: Column) -> Column:
    target = value.try_cast("double")
    near = F.greatest(F.lit(0.0), 1 - F.abs(price - target) / target)
    return F.when(price.isNotNull() & (target > 0), near).otherwise(0.25)


def satisfies_phrase(text: Column, blob: Column) -> Column:
    """1 if the flattened phrase is in the text, else 0.7 times the share of its terms that are, as substrings."""
    needle, words = T.match_text(text), T.terms(text)
    hits = F.size(F.filter(words, lambda t: F.contains(blob, t)))
    partial = F.when(F.size(words) > 0, 0.7 * hits / F.size(words)).otherwise(0.0)
    return F.when(needle == "", 0.0).when(F.contains(blob, needle), 1.0).otherwise(partial)


def satisfaction(c: Column) -> Column:
    """How far the product row meets one constraint, 0 to 1."""
    return (
        F.when(c["kind"] == "material", satisfies_material(c["value"], F.col("first_material"), F.col("materials")))
        .when(c["kind"] == "color", satisfies_color(c["value"], F.col("first_color"), F.col("colors")))
        .when(c["kind"] == "budget", satisfies_budget(c["value"], F.col("price")))
        .otherwise(satisfies_phrase(c["text"], F.col("blob")))
    )


def constraint_score(constraints: Column) -> Column:
    """Weighted mean satisfaction; longer constraints weigh up to three times as much. 0 without any."""
    pairs = F.transform(
        constraints,
        lambda c: F.struct(
            ((1 + F.least(F.lit(2.0), F.size(T.terms(c["text"])) / 6.0)) * c["weight"]).alias("w"), satisfaction(c).alias("s")
        ),
    )
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"])
    met = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"] * p["s"])
    return F.when(total > 0, met / total).otherwise(0.0)


def profile_affinity(tags: Column, blob: Column) -> Column:
    """The share of profile tags found in the text."""
    low = F.transform(tags, lambda t: F.lower(t))
    hits = F.size(F.filter(low, lambda t: (t != "") & F.contains(blob, t)))
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, hits / F.size(tags)).otherwise(0.0)


def candidate_pool(asked: DataFrame, index: DataFrame, fallback: DataFrame, config: Config = Config()) -> DataFrame:
    """``asked(query, category)`` -> (query, doc): the category's products, and below ``min_candidates`` of
    them also the best lexical ones of ``fallback(query, doc, score)``."""
    bucket = asked.join(index.select("category", F.col("parent_asin").alias("doc")), "category").select("query", "doc")
    if not config.use_category_lock:
        bucket = bucket.limit(0)
    sizes = asked.select("query").join(bucket.groupBy("query").agg(F.count("*").alias("size")), "query", "left")
    small = sizes.where(F.coalesce("size", F.lit(0)) < config.min_candidates).select("query")
    window = Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "doc")
    best = (
        fallback.join(small, "query", "left_semi")
        .withColumn("_n", F.row_number().over(window))
        .where(F.col("_n") <= config.global_fallback_limit)
        .select("query", "doc")
    )
    return bucket.unionByName(best).distinct()


def blend(config: Config = Config()) -> Column:
    """The score of a candidate row: lexical, constraints (array), popularity, preference_tags, cosine."""
    cold = F.size("constraints") == 0
    score = config.w_bm25 * F.coalesce("lexical", F.lit(0.0))
    if config.use_constraint_scoring:
        score = score + config.w_constraint * constraint_score(F.col("constraints"))
    if config.use_popularity_prior:
        score = score + config.w_popularity * F.col("popularity")
    if config.use_profile_prior:
        term = config.w_profile * profile_affinity(F.col("preference_tags"), F.col("blob"))
        score = score + (F.when(cold, term).otherwise(0.0) if config.profile_cold_start_only else term)
    if config.use_dense_rerank:
        term = config.w_dense * F.coalesce("cosine", F.lit(0.0))
        score = score + (F.when(cold, term).otherwise(0.0) if config.dense_cold_start_only else term)
    return score


def ranked(rows: DataFrame, k: int, config: Config = Config()) -> DataFrame:
    """(query, doc, score, rank): the first k by score rounded to six places, ties by document."""
    scored = rows.select("query", F.col("parent_asin").alias("doc"), F.round(blend(config), 6).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def padded(best: DataFrame, pool: DataFrame, popular: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Fill lists up to k: ranked ones, then the pool by popularity, then the catalog's most popular.

    ``pool(query, doc, popularity)``; ``popular(doc, popularity)`` holds at most a few dozen rows, and only lists
    that are still short meet it. ``queries(query)``: all queries, if some may have no pool.
    """
    own = (
        best.select("query", "doc", F.lit(0).alias("tier"), F.col("rank").cast("double").alias("place"))
        .unionByName(pool.select("query", "doc", F.lit(1).alias("tier"), (-F.round("popularity", 6)).alias("place")))
        .groupBy("query", "doc").agg(F.min(F.struct("tier", "place")).alias("at"))
    )
    first = Window.partitionBy("query").orderBy("at.tier", "at.place", "doc")
    own = checkpointed(own.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n"))
    sizes = own.groupBy("query").agg(F.count("*").alias("n"))
    every = sizes.select("query") if queries is None else queries.select("query").distinct()
    short = every.join(sizes, "query", "left").where(F.coalesce("n", F.lit(0)) < k).select("query")
    more = short.crossJoin(F.broadcast(popular.limit(64))).select(
        "query", "doc", F.struct(F.lit(2).alias("tier"), (-F.round("popularity", 6)).alias("place")).alias("at")
    )
    each = own.unionByName(more).groupBy("query", "doc").agg(F.min("at").alias("at"))
    out = each.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return out.select("query", "doc", "rank", F.col("at.tier").alias("tier"))


def gated(count: Column, turn: Column, constraints: Column, k: int, config: Config = Config()) -> Column:
    """How many of ``count`` results to show."""
    if not config.use_confidence_gate:
        return F.least(count, F.lit(k))
    held = (turn <= config.gate_max_turn) & (constraints < config.gate_min_constraints)
    return F.least(count, F.when(held, F.lit(config.gate_list_size)).otherwise(F.lit(k)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def permuted(order: Column, n: Column) -> Column:
    """A full permutation of 0..n-1 that begins with the valid, distinct places of ``order``."""
    good = F.array_distinct(F.filter(order, lambda i: i.isNotNull() & (i >= 0) & (i < n)))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(good, F.array_except(every, good))


def mmr(rows: DataFrame, k: int = 10, lam: float = 0.82) -> DataFrame:
    """``rows(query, doc, score, title_tokens, hard)`` -> (query, doc, rank), diversified by title overlap.

    A query with a hard signal (``hard``, the same in all its rows; without the column none has) keeps its order by score. Greedy, so one
    query's list is picked in one Python call. At most 6k rows a query enter it, cut by a window beforehand;
    nothing larger is gathered. Values are compared at nine places, ties go to the higher score.
    """
    rows = rows if "hard" in rows.columns else rows.withColumn("hard", F.lit(False))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    head = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 6 * k).drop("_n")
    kind = dict(head.dtypes)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "doc"], ascending=[False, True])
        left = [(r.doc, float(r.score), set(r.title_tokens)) for r in group.itertuples()]
        if group["hard"].iloc[0]:
            chosen = left[:k]
        else:
            top, chosen = max(s for _, s, _ in left) or 1.0, []
            while left and len(chosen) < k:
                value = [
                    round(lam * s / top - (1 - lam) * max((len(t & c) / max(1, len(t | c)) for *_, c in chosen), default=0.0), 9)
                    for _, s, t in left
                ]
                chosen.append(left.pop(value.index(max(value))))
        return pd.DataFrame({"query": group["query"].iloc[0], "doc": [c[0] for c in chosen], "rank": range(1, len(chosen) + 1)})

    return head.groupBy("query").applyInPandas(pick, f"query {kind['query']}, doc {kind['doc']}, rank int")


def fallback_response(asked: DataFrame, index: DataFrame, popular: DataFrame, k: int = 10) -> DataFrame:
    """``asked(query, category)`` -> (query, doc, rank): the category's most popular products, then the catalog's."""
    pool = asked.join(index, "category").select("query", F.col("parent_asin").alias("doc"), "popularity")
    first = Window.partitionBy("query").orderBy(F.desc(F.round("popularity", 6)), "doc")
    head = pool.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query", "doc", "rank")
    own = head.select("query", "doc", F.lit(0.0).alias("popularity"))
    return padded(head, own, popular, k, asked).select("query", "doc", "rank")
