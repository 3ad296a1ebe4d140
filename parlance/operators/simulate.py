"""The simulated customer: hidden intent cards, messages, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions import vocabulary as V


def intent_card(products: DataFrame, limit: int = 180) -> DataFrame:
    """(parent_asin, hard, soft): at most two constraints each, drawn from a product's own fields.

    Features and details, with the first material put first and the first colour second, and the price
    last; cleaned, repeats and empty ones dropped; the title if nothing is left.
    """
    given = F.concat(
        F.coalesce(T.flatten_list("features"), F.array().cast("array<string>")),
        F.coalesce(T.flatten_map("details"), F.array().cast("array<string>")),
    )
    corpus = T.searchable_text()
    material = F.lower(F.regexp_extract(corpus, rf"(?i)\b({'|'.join(V.MATERIALS)})\b", 1))
    color = F.lower(F.regexp_extract(corpus, rf"(?i)\b({'|'.join(V.COLORS)})\b", 1))
    none = F.array().cast("array<string>")
    first = F.concat(F.when(material != "", F.array(material)).otherwise(none), given)
    colored = F.concat(F.slice(first, 1, 1), F.array(F.concat(F.lit("color: "), color)), F.slice(first, F.lit(2), F.greatest(F.size(first), F.lit(1))))
    named = F.when(color != "", colored).otherwise(first)
    price = F.when(F.coalesce("price", F.lit("")) != "", F.array(F.concat(F.lit("budget around $"), "price"))).otherwise(none)
    cleaned = F.array_distinct(
        F.filter(F.transform(F.concat(named, price), lambda x: T.clean_constraint(x, limit)), lambda x: x != "")
    )
    title = T.clean_constraint(F.coalesce(F.nullif("title", F.lit("")), F.lit("product")), limit)
    card = F.when(F.size("cleaned") > 0, F.col("cleaned")).otherwise(F.array("title"))
    rows = products.select("parent_asin", cleaned.alias("cleaned"), title.alias("title")).select("parent_asin", card.alias("card"))
    soft = F.when(F.size("card") > 2, F.slice("card", 3, 2)).otherwise(F.slice("card", 1, 1))
    return rows.select("parent_asin", F.slice("card", 1, 2).alias("hard"), soft.alias("soft"))


def override_message(new_value: Column) -> Column:
    return F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), new_value, F.lit("."))


def opening_message(scenario: Column, category: Column, hard: Column, soft: Column) -> Column:
    """The first message. A buying customer discloses the first hard constraint, an overriding one a decoy."""
    start = F.concat(F.lit("I'm looking for "), category)
    old = F.coalesce(F.try_element_at(soft, F.lit(-1)), F.lit("I prefer a different style."))
    return (
        F.when((scenario == "buying") & (F.size(hard) > 0), F.concat(start, F.lit(". A key requirement is: "), F.get(hard, F.lit(0)), F.lit(".")))
        .when(scenario == "intent_override", F.concat(start, F.lit(". "), old))
        .otherwise(F.concat(start, F.lit(", but I'm still exploring.")))
    )


def reply_matches(attribute: Column, hard: Column, soft: Column, disclosed: Column) -> Column:
    """Up to two undisclosed constraints that a question about ``attribute`` brings out."""
    known = F.when(attribute.isin(*V.ATTRIBUTES), attribute).otherwise(F.lit(V.OPEN))
    fits = F.filter(
        F.concat(hard, soft),
        lambda c: ~F.array_contains(disclosed, c) & ((known == V.OPEN) | (T.classify_constraint(c) == known)),
    )
    return F.slice(fits, 1, 2)


def reply_message(scenario: Column, attribute: Column, boundary_used: Column, matches: Column) -> Column:
    """The customer's answer to a question; null is silence from the agent."""
    known = F.when(attribute.isin(*V.ATTRIBUTES), attribute).otherwise(F.lit(V.OPEN))
    return (
        F.when(
            (scenario == "boundary") & ~boundary_used & attribute.isNotNull(),
            F.concat(F.lit("I don't have a preference for "), attribute, F.lit("; please use your judgment.")),
        )
        .when(attribute.isNull(), F.lit("Those options are not quite right yet. Ask me about one specific attribute."))
        .when(F.size(matches) == 0, F.concat(F.lit("I don't have an additional preference for "), known, F.lit(".")))
        .otherwise(F.concat(F.lit("For that, what matters is: "), F.array_join(matches, "; "), F.lit(".")))
    )
