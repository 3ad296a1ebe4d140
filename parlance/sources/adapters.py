"""Adapters: star-schema and corpus tables as products, messages, sessions.

The tables hold no product catalog and no shopping sessions. These adapters derive some by rule, so
that every operator runs over data of any scale; the rules are this repository's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import vocabulary as V
from parlance.sources.shared import dealt

#: Products in one task.
PRODUCTS = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` with counts from ``lineitem``, in the shape of a catalog.

    Every 13 keys take one of nine materials as a feature, small and large parts a size, every 11th a
    use; every 17th has no price, every 19th no details, every second a description. Rows are dealt out by
    ``parent_asin``, so what is grouped by product needs no other shuffle.
    """
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("sold"))
    number = F.pmod(key, F.lit(13))
    material = F.element_at(F.array(*map(F.lit, V.MATERIALS)), (number + 1).cast("int"))
    features = F.filter(
        F.array(
            F.concat("p_type", F.lit(" range")),
            F.when(number < 9, F.concat(F.lit("made of "), material)),
            F.when(F.col("p_size") > 40, F.lit("wide fit")).when(F.col("p_size") < 6, F.lit("narrow sizing")),
            F.when(key % 11 == 0, F.lit("for hiking and outdoor work")),
        ),
        lambda f: f.isNotNull(),
    )
    details = F.create_map(F.lit("Brand"), F.col("p_brand"), F.lit("Size_code"), F.col("p_size").cast("string"))
    rows = part.join(sold, "p_partkey", "left").withColumn("parent_asin", F.concat(F.lit("P"), key.cast("string")))
    return dealt(rows, "parent_asin", part.count(), PRODUCTS).select(
        "parent_asin",
        F.col("p_name").alias("title"),
        features.alias("features"),
        F.when(key % 2 == 0, F.array(F.concat(F.lit("Item "), "p_name"))).otherwise(F.array().cast("array<string>")).alias("description"),
        F.when(key % 17 != 0, F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))).alias("price"),
        F.array("p_type", "p_brand").alias("categories"),
        F.when(key % 19 != 0, details).otherwise(F.create_map().cast("map<string,string>")).alias("details"),
        (F.lit(1.0) + F.pmod(key * 7, F.lit(41)) / 10.0).alias("average_rating"),
        F.coalesce("sold", F.lit(0)).cast("bigint").alias("rating_number"),
        F.col("p_brand").alias("store"),
    )


#: The same products in SQL; maps are two lists, flat (``key: value``) and plain (``key value``).
PRODUCTS_SQL = """
sold AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
product AS (
  SELECT 'P' || p_partkey AS parent_asin, p_name AS title,
    list_filter([p_type || ' range',
      CASE WHEN p_partkey % 13 < 9 THEN 'made of ' ||
        ['cotton','polyester','nylon','leather','wool','spandex','silk','rayon','fabric'][(p_partkey % 13)::INT + 1] END,
      CASE WHEN p_size > 40 THEN 'wide fit' WHEN p_size < 6 THEN 'narrow sizing' END,
      CASE WHEN p_partkey % 11 = 0 THEN 'for hiking and outdoor work' END], lambda f: f IS NOT NULL) AS features,
    CASE WHEN p_partkey % 2 = 0 THEN ['Item ' || p_name] ELSE []::VARCHAR[] END AS description,
    CASE WHEN p_partkey % 17 <> 0 THEN '$' || p_retailprice::DECIMAL(12,2)::VARCHAR END AS price,
    [p_type, p_brand] AS categories,
    CASE WHEN p_partkey % 19 <> 0 THEN ['Brand: ' || p_brand, 'Size_code: ' || p_size] ELSE []::VARCHAR[] END AS flat,
    CASE WHEN p_partkey % 19 <> 0 THEN 'Brand ' || p_brand || ' Size_code ' || p_size ELSE '' END AS plain,
    1.0::DOUBLE + ((p_partkey * 7) % 41) / 10.0::DOUBLE AS average_rating,
    coalesce(n, 0)::BIGINT AS rating_number, p_brand AS store
  FROM part LEFT JOIN sold ON l_partkey = p_partkey)
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as (doc, category, text) for full-text search."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc"), F.col("lang").alias("category"), F.coalesce("text", F.lit("")).alias("text")
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as (query, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session a customer with an order: the part of the last line of the last order is the target.

    (sample_id, scenario_type, target, override_turn, preference_tags). Scenarios follow the mix 40,
    40, 15, 5 by a draw on the customer's key.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    last = F.max(F.struct("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey")).alias("last")
    bought = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_custkey").agg(last)
    draw = F.pmod(F.col("o_custkey") * 7919 + 13, F.lit(100))
    scenario = (
        F.when(draw < 40, "buying").when(draw < 80, "browsing").when(draw < 95, "intent_override").otherwise("boundary")
    )
    return bought.select(
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("sample_id"),
        scenario.alias("scenario_type"),
        F.concat(F.lit("P"), F.col("last.l_partkey").cast("string")).alias("target"),
        (F.lit(3) + F.pmod("o_custkey", F.lit(2))).cast("int").alias("override_turn"),
        F.array(F.element_at(F.array(*map(F.lit, ("red", "blue", "wide", "cotton", "outdoor"))), (F.pmod("o_custkey", F.lit(5)) + 1).cast("int"))).alias("preference_tags"),
    )


SESSIONS_SQL = """
session AS (
  SELECT 'S' || o_custkey AS sample_id, o_custkey,
    CASE WHEN (o_custkey * 7919 + 13) % 100 < 40 THEN 'buying' WHEN (o_custkey * 7919 + 13) % 100 < 80 THEN 'browsing'
         WHEN (o_custkey * 7919 + 13) % 100 < 95 THEN 'intent_override' ELSE 'boundary' END AS scenario_type,
    'P' || arg_max(l_partkey, (o_orderdate, o_orderkey, l_linenumber, l_partkey)) AS target,
    (3 + o_custkey % 2)::INT AS override_turn,
    [['red','blue','wide','cotton','outdoor'][(o_custkey % 5)::INT + 1]] AS preference_tags
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey)
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session records from ``events``: a click or purchase is a hit; turn and rank follow from its value."""
    events = table(spark, sf_dir, "events")
    hit = F.col("event_type").isin("click", "purchase")
    cents = F.round(F.col("value") * 100).cast("bigint")
    names = F.array(*(F.lit(s) for s, _ in V.SCENARIO_MIX))
    turn = F.when(hit, (F.lit(1) + F.pmod(cents, F.lit(10))).cast("int"))
    rank = F.when(hit, (F.lit(1) + F.pmod(F.floor(cents / 10), F.lit(10))).cast("int"))
    return events.select(
        F.col("event_id").alias("sample_id"),
        F.element_at(names, (F.pmod("user_id", F.lit(4)) + 1).cast("int")).alias("scenario_type"),
        hit.alias("hit"), turn.alias("first_hit_turn"), rank.alias("best_rank"),
        F.coalesce(F.lit(1.0) / rank, F.lit(0.0)).alias("reciprocal_rank"),
    )


RESULTS_SQL = """
cents AS (SELECT *, round(value * 100)::BIGINT AS c, event_type IN ('click', 'purchase') AS hit FROM events),
result AS (
  SELECT event_id AS sample_id, ['buying','browsing','intent_override','boundary'][(user_id % 4)::INT + 1] AS scenario_type, hit,
    CASE WHEN hit THEN (1 + c % 10)::INT END AS first_hit_turn, CASE WHEN hit THEN (1 + (c // 10) % 10)::INT END AS best_rank,
    CASE WHEN hit THEN 1.0::DOUBLE / (1 + (c // 10) % 10) ELSE 0.0 END AS reciprocal_rank FROM cents)
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer messages (session_id, turn, message): user turns of ``conversations``, every third as a template.

    The first user turn of a conversation whose id leaves 0 after division by 2 becomes a template
    opening, later ones template replies by turn, with the message's first words as payload.
    """
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    words = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 4), " ")
    payload = F.regexp_replace(words, "[.;:]", "")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.pmod("conv_id", F.lit(len(CATEGORIES))) + 1).cast("int"))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    opening = (
        F.when(kind == 0, F.concat(F.lit("I'm looking for "), category, F.lit(", but I'm still exploring.")))
        .when(kind == 2, F.concat(F.lit("I'm looking for "), category, F.lit(". A key requirement is: "), payload, F.lit(".")))
        .when(kind == 4, F.concat(F.lit("I'm looking for "), category, F.lit(". "), payload))
        .when(kind == 1, F.concat(F.lit("Hey, shopping for some "), category, F.lit(" and it must be "), payload))
        .otherwise(F.col("text"))
    )
    reply = (
        F.when(kind == 0, F.concat(F.lit("For that, what matters is: "), payload, F.lit("; color: red.")))
        .when(kind == 1, F.lit("I don't have an additional preference for material."))
        .when(kind == 2, F.lit("I don't have a preference for other; please use your judgment."))
        .when(kind == 3, F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), payload, F.lit(".")))
        .when(kind == 4, F.lit("Those options are not quite right yet. Ask me about one specific attribute."))
        .otherwise(F.col("text"))
    )
    return rows.select(
        F.col("conv_id").alias("session_id"),
        (F.floor(F.col("turn") / 2) + 1).cast("int").alias("turn"),
        F.when(F.col("turn") == 0, opening).otherwise(reply).alias("message"),
    )


#: Category names as the products of ``part`` carry them: a type and a brand.
CATEGORIES = ("ECONOMY Brand#1", "SMALL Brand#2", "MEDIUM Brand#3", "LARGE Brand#4", "PROMO Brand#5")
_LIST = "['" + "','".join(CATEGORIES) + "']"
MESSAGES_SQL = f"""
said AS (
  SELECT conv_id, turn, text, (conv_id + turn) % 6 AS kind, {_LIST}[(conv_id % {len(CATEGORIES)})::INT + 1] AS cat,
    regexp_replace(array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:4], ' '), '[.;:]', '', 'g') AS p
  FROM conversations WHERE role = 'user'),
message AS (
  SELECT conv_id AS session_id, (turn // 2 + 1)::INT AS turn, CASE WHEN turn = 0 THEN
    CASE kind WHEN 0 THEN 'I''m looking for ' || cat || ', but I''m still exploring.'
      WHEN 2 THEN 'I''m looking for ' || cat || '. A key requirement is: ' || p || '.'
      WHEN 4 THEN 'I''m looking for ' || cat || '. ' || p
      WHEN 1 THEN 'Hey, shopping for some ' || cat || ' and it must be ' || p ELSE text END
  ELSE CASE kind WHEN 0 THEN 'For that, what matters is: ' || p || '; color: red.'
      WHEN 1 THEN 'I don''t have an additional preference for material.'
      WHEN 2 THEN 'I don''t have a preference for other; please use your judgment.'
      WHEN 3 THEN 'Actually, ignore my earlier preference. What I need is: ' || p || '.'
      WHEN 4 THEN 'Those options are not quite right yet. Ask me about one specific attribute.' ELSE text END END AS message
  FROM said)
"""
