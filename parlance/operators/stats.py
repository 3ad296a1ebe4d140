"""Resampling, paired comparisons, sampling and diagnostics over session results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions import vocabulary as V
from parlance.operators import lexical as L
from parlance.operators import metrics as M
from parlance.sources.shared import checkpointed


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with i = 0, 1, ... in order of ``key``, without gathering them in one task.

    Rows are sorted into ranges; counts of the ranges, one number each, give every range its offset.
    """
    # Ranges come from a sample that differs from run to run, so they are fixed by a checkpoint.
    ranged = checkpointed(rows.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    counts = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}  # one row a partition
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_p int, _start bigint"))
    order = Window.partitionBy("_p").orderBy(key)
    made = ranged.join(offsets, "_p").withColumn("i", (F.row_number().over(order) - 1 + F.col("_start")).cast("bigint"))
    return made.drop("_p", "_start")


def resamples(spark: SparkSession, n: int, rounds: int, seed: int) -> DataFrame:
    """(round, i): n seeded draws with replacement for every round."""
    pairs = spark.range(n * rounds).select((F.col("id") / n).cast("bigint").alias("round"), (F.col("id") % n).alias("k"))
    return pairs.select("round", T.draw(seed, "round", "k", modulus=n).alias("i"))


def _drawn(rows: DataFrame, rounds: int, seed: int) -> DataFrame:
    """``rows(i, ...)`` as often as they are drawn, with ``round``. A draw travels as one number, its place and round."""
    made = resamples(rows.sparkSession, rows.count(), rounds, seed).select((F.col("i") * rounds + F.col("round")).alias("_draw"))
    met = made.join(rows, F.expr(f"_draw div {rounds}") == F.col("i"))
    return met.withColumn("round", F.col("_draw") % rounds)


def _interval(values: DataFrame, column: str, rounds: int) -> DataFrame:
    """Mean, population deviation, and the values at places int(0.025 B) and int(0.975 B) of ``rounds`` values."""
    ordered = values.agg(  # one number a round
        F.array_sort(F.collect_list(column)).alias("v"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation")
    )
    low, high = int(0.025 * rounds), int(0.975 * rounds)
    return ordered.select("mean", "deviation", F.get("v", F.lit(low)).alias("low"), F.get("v", F.lit(min(high, rounds - 1))).alias("high"))


def bootstrap(results: DataFrame, rounds: int = 100, seed: int = 1) -> DataFrame:
    """Intervals of the composite over seeded resamples of the sessions. One row."""
    rows = numbered(results.select("sample_id", "hit", "reciprocal_rank", "first_hit_turn"), "sample_id")
    scores = _drawn(rows, rounds, seed).groupBy("round").agg(
        F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("reciprocal_rank").alias("mrr"),
        F.avg(F.coalesce("first_hit_turn", F.lit(M.MISS_TURN)).cast("double")).alias("mttc"),
    )
    scored = scores.select(M.composite(F.col("hit_rate"), F.col("mrr"), F.col("mttc")).alias("composite"))
    return _interval(scored, "composite", rounds)


def session_score(prefix: str = "") -> Column:
    """One session's share of the composite."""
    turn = F.coalesce(f"{prefix}first_hit_turn", F.lit(M.MISS_TURN))
    return 0.5 * F.col(f"{prefix}hit").cast("double") + 0.3 * F.col(f"{prefix}reciprocal_rank") + 0.02 * (M.MISS_TURN - turn)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sample_id, delta): b's session score less a's, for sessions in both."""
    left = a.select("sample_id", session_score().alias("sa"))
    right = b.select("sample_id", session_score().alias("sb"))
    return left.join(right, "sample_id").select("sample_id", (F.col("sb") - F.col("sa")).alias("delta"))


def improved_regressed(deltas: DataFrame, eps: float = 1e-9) -> DataFrame:
    return deltas.agg(
        F.count("*").alias("sessions"), F.avg("delta").alias("mean_delta"),
        F.count_if(F.col("delta") > eps).alias("improved"), F.count_if(F.col("delta") < -eps).alias("regressed"),
    )


def paired_interval(deltas: DataFrame, rounds: int = 100, seed: int = 2) -> DataFrame:
    """Interval of the mean paired difference; significant if it excludes 0."""
    rows = numbered(deltas, "sample_id")
    means = _drawn(rows, rounds, seed).groupBy("round").agg(F.avg("delta").alias("d"))
    out = _interval(means, "d", rounds)
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def apportion(totals: DataFrame, mix=V.SCENARIO_MIX) -> DataFrame:
    """``totals(total)`` -> (total, scenario, count): largest remainders, so counts add up exactly."""
    spark = totals.sparkSession
    shares = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(mix)], "ord int, scenario string, share double")
    rows = totals.crossJoin(F.broadcast(shares)).withColumn("exact", F.round(F.col("total") * F.col("share"), 9))
    rows = rows.withColumn("floor", F.floor("exact"))
    order = Window.partitionBy("total").orderBy(F.desc(F.round(F.col("exact") - F.col("floor"), 9)), "ord")
    left = F.col("total") - F.sum("floor").over(Window.partitionBy("total"))
    more = F.when(F.row_number().over(order) <= left, 1).otherwise(0)
    return rows.select("total", "scenario", (F.col("floor") + more).cast("bigint").alias("count"))


def eligible(products: DataFrame, exclude: DataFrame) -> DataFrame:
    """Products with features and details that are not among ``exclude(parent_asin)``."""
    rows = products.where((F.size("features") > 0) & (F.size("details") > 0))
    return rows.join(exclude.select("parent_asin").distinct(), "parent_asin", "left_anti")


def sample_uniform(rows: DataFrame, key: str, n: int, seed: int = 3) -> DataFrame:
    """n rows without replacement, the same each time: those with the least hashes. n is the feature."""
    return rows.withColumn("_d", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)))).orderBy("_d", key).limit(n).drop("_d")


def sample_matched(pool: DataFrame, reference: DataFrame, n: int, seed: int = 4) -> DataFrame:
    """``pool(parent_asin, rating_number)``, ``reference(rating_number)`` -> (place, parent_asin): n seeded draws
    from the reference, for each the product of nearest popularity that is still free.

    Places are found over all of the pool and the reference. A draw takes the free product with the least
    distance in the order by popularity, so no more than n places on either side of each draw's own are looked
    at: those rows, n (2 n + 1) at most, and n is the feature, are what the greedy walk reads.
    """
    spark = pool.sparkSession
    known = numbered(reference.select("rating_number"), "rating_number")
    rows = numbered(pool.select("parent_asin", "rating_number", F.struct("rating_number", "parent_asin").alias("k")), "k")
    size, total = known.count(), rows.count()
    if not size or not total:
        return spark.createDataFrame([], "place bigint, parent_asin string")
    draws = spark.range(n).select(F.col("id").alias("place"), T.draw(seed, "id", modulus=size).alias("i"))
    goals = {r.place: r.rating_number for r in F.broadcast(draws).join(known, "i").collect()}
    values = sorted(set(goals.values()))
    starts = dict(zip(values, rows.agg(*(F.count_if(F.col("rating_number") < v) for v in values)).first(), strict=True))
    near: list[list[int]] = []  # stretches of places, merged where they meet
    for at in sorted(starts.values()):
        if near and at - n <= near[-1][1]:
            near[-1][1] = at + n
        else:
            near.append([at - n, at + n])
    wanted = reduce(lambda a, b: a | b, (F.col("i").between(*x) for x in near))
    ids = {r.i: r.parent_asin for r in rows.where(wanted).select("i", "parent_asin").collect()}
    out = []
    for place in range(min(n, total)):
        start = starts[goals[place]]
        hit = next(i for d in range(total + 1) for i in (start + d, start - d) if i in ids)
        out.append((place, ids.pop(hit)))
    return spark.createDataFrame(out, "place bigint, parent_asin string")


def popularity_summary(rows: DataFrame) -> DataFrame:
    """True median, nearest-rank quartiles (half to even) and the share with a price. One row."""
    counted = numbered(rows.select("parent_asin", "price", F.struct("rating_number", "parent_asin").alias("k")), "k")
    last = counted.agg((F.count("*") - 1).alias("last"))
    with_last = counted.crossJoin(F.broadcast(last))
    at = lambda place: F.max(F.when(F.col("i") == place, F.col("k.rating_number")))
    return with_last.agg(
        ((at(F.floor(F.col("last") / 2)) + at(F.ceil(F.col("last") / 2))) / 2.0).alias("median"),
        at(F.bround(0.25 * F.col("last")).cast("bigint")).alias("p25"), at(F.bround(0.75 * F.col("last")).cast("bigint")).alias("p75"),
        F.round(F.avg((F.coalesce("price", F.lit("")) != "").cast("double")), 4).alias("priced"),
    )


def decile_edges(rows: DataFrame, column: str, key: str) -> DataFrame:
    """(decile, edge): values at places round(q / 10 * last), q = 0..10."""
    counted = numbered(rows.select(F.col(column).alias("v"), F.struct(F.col(column), F.col(key)).alias("k")), "k")
    last = counted.agg((F.count("*") - 1).alias("last"))
    picks = F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda q: F.struct(q.alias("decile"), F.bround(q / 10.0 * F.col("last")).cast("bigint").alias("i"))))
    return last.select(picks.alias("p")).select("p.*").join(counted, "i").select("decile", F.col("v").alias("edge"))


def yield_prior(cards: DataFrame) -> DataFrame:
    """``cards(parent_asin, hard, soft)`` -> (attribute, share): how many cards hold each attribute."""
    n = cards.agg(F.count("*").alias("n"))
    texts = cards.select("parent_asin", F.explode(F.array_distinct(F.concat("hard", "soft"))).alias("text"))
    each = texts.select("parent_asin", T.classify_constraint("text").alias("attribute")).distinct()
    counts = each.groupBy("attribute").agg(F.count("*").alias("cards"))
    return counts.crossJoin(F.broadcast(n)).select("attribute", (F.col("cards") / F.col("n")).alias("share"))


def exactness(constraints: DataFrame, catalog: DataFrame) -> DataFrame:
    """``constraints(sample_id, text, target)``, ``catalog(parent_asin, norm)`` -> one row a constraint:
    origin, verbatim_in_target, catalog_matches.

    Each distinct needle meets the catalog once, however many sessions state it.
    """
    low = T.normalise("text")
    rows = constraints.withColumn("needle", low)
    needles = rows.select("needle").where("needle <> ''").distinct()
    found = L.containing(needles, catalog.select(F.col("parent_asin").alias("doc"), F.col("norm").alias("text")))
    hits = found.groupBy("needle").agg(F.count("*").alias("catalog_matches"))
    target = catalog.select(F.col("parent_asin").alias("target"), F.col("norm").alias("own"))
    made = F.col("text").startswith("color: ") | F.col("text").startswith("budget around $") | F.col("needle").isin(*V.MATERIALS)
    return rows.join(hits, "needle", "left").join(target, "target").select(
        "sample_id", "text", F.when(made, "synthesised").otherwise("mined").alias("origin"),
        ((F.col("needle") != "") & F.contains("own", F.col("needle"))).alias("verbatim"), F.coalesce("catalog_matches", F.lit(0)).alias("matches"),
    )


def exactness_summary(rows: DataFrame) -> DataFrame:
    """Shares of verbatim, unique and narrow constraints, by origin and over all (``ALL``)."""
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 1)
    rolled = rows.rollup("origin").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("constraints"), pct(F.col("verbatim")).alias("pct_verbatim"),
        pct(F.col("matches") == 1).alias("pct_unique"), pct(F.col("matches").between(1, 10)).alias("pct_narrow"),
    )
    return rolled.withColumn("origin", F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col("origin"))).drop("_g")


def rank_diagnosis(scored: DataFrame, eps: float = 1e-9) -> DataFrame:
    """``scored(query, doc, score, target)`` -> per query: strictly_above, tied, gap of the target to the top."""
    own = scored.where("doc = target").select("query", F.col("score").alias("own"))
    rows = scored.join(own, "query")
    return rows.groupBy("query").agg(
        F.count_if(F.col("score") > F.col("own") + eps).alias("strictly_above"),
        (F.count_if(F.abs(F.col("score") - F.col("own")) <= eps) - 1).alias("tied"),
        F.round(F.max("score") - F.max("own"), 6).alias("gap"), F.count("*").alias("pool_size"),
    )


def rank_summary(diagnosis: DataFrame) -> DataFrame:
    """``diagnosis(query, known, strictly_above, rank, gap)`` -> where targets stand, by the number of constraints
    known and over all (-1): first, behind equal scores only, behind better scores, and of the latter the upper
    medians of the gap to the top and of the products above."""
    beaten = "IF(strictly_above > 0, {}, NULL)"
    median = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {beaten.format(c)} DESC)")
    rolled = diagnosis.rollup("known").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("sessions"), F.count_if(F.col("rank") == 1).alias("rank_1"),
        F.count_if((F.col("rank") > 1) & (F.col("strictly_above") == 0)).alias("lost_to_ties"),
        F.count_if(F.col("strictly_above") > 0).alias("lost_to_scoring"),
        median("gap").alias("median_gap"), median("strictly_above").cast("bigint").alias("median_above"),
    )
    return rolled.withColumn("known", F.when(F.col("_g") == 1, F.lit(-1)).otherwise(F.col("known")).cast("bigint")).drop("_g")


def coverage_summary(ceiling: DataFrame) -> DataFrame:
    """``ceiling(query, higher, equal, lower)`` -> one row: sessions, targets at the top, and the rivals above the
    others by what they cover."""
    sums = {"rivals_beating_on_evidence": "higher", "rivals_in_saturated_ties": "equal", "rivals_mis_scored": "lower"}
    above = F.col("higher") + F.col("equal") + F.col("lower")
    return ceiling.agg(
        F.count("*").alias("sessions"), F.count_if(above == 0).alias("none_above"), F.sum(above).alias("rivals_above_targets"),
        *(F.sum(c).alias(n) for n, c in sums.items()),
    )


def coverage_histogram(covered: DataFrame) -> DataFrame:
    """``covered(query, doc, target, covered)`` -> (query, covered, products, of_target): how many products of a
    pool cover so many constraints, and whether the target is one of them."""
    return covered.groupBy("query", F.col("covered").cast("bigint").alias("covered")).agg(
        F.count("*").alias("products"), F.max(F.col("doc") == F.col("target")).alias("of_target")
    )


def coverage(text: Column, constraints: Column) -> Column:
    """How many constraint strings are in the text."""
    return F.size(F.filter(constraints, lambda c: F.contains(F.lower(text), c)))


def coverage_ceiling(scored: DataFrame) -> DataFrame:
    """``scored(query, doc, score, target, covered)`` -> of the documents above the target, how many cover more,
    as many and fewer constraints."""
    own = scored.where("doc = target").select("query", F.col("score").alias("own"), F.col("covered").alias("goal"))
    above = F.col("score") > F.col("own")
    return scored.join(own, "query").groupBy("query").agg(
        F.count_if(above & (F.col("covered") > F.col("goal"))).alias("higher"), F.count_if(above & (F.col("covered") == F.col("goal"))).alias("equal"),
        F.count_if(above & (F.col("covered") < F.col("goal"))).alias("lower"), F.max("goal").alias("target_coverage"),
    )


def quantiles(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Mean, median and nearest-rank p95 and p99 (place int(f n + 0.5), kept within 1..n), and the largest."""
    counted = numbered(rows.select(F.col(value).alias("v"), F.struct(F.col(value), F.col(key)).alias("k")), "k")
    size = counted.agg(F.count("*").alias("n"))
    rows = counted.crossJoin(F.broadcast(size))
    place = lambda f: F.greatest(F.lit(1), F.least(F.col("n"), F.floor(f * F.col("n") + 0.5))) - 1
    at = lambda p: F.max(F.when(F.col("i") == p, F.col("v")))
    return rows.agg(
        F.round(F.avg("v"), 6).alias("mean"),
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2.0).alias("median"),
        at(place(0.95)).alias("p95"), at(place(0.99)).alias("p99"), F.max("v").alias("largest"),
    )
