"""Conversation state as relations: what each session knows after each turn.

The fold over a session's messages needs no loop: a constraint is known from the turn of its first
mention on, an attribute is spent from the turn of the reply that says so, and the category is the
first that any message named. Windows over (session, turn) state just that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.config import Config
from parlance.functions import text as T
from parlance.operators import dialogue as D
from parlance.sources.shared import checkpointed

KEYS = ["session_id", "turn"]


def parsed(messages: DataFrame, lookup: DataFrame) -> DataFrame:
    """``messages(session_id, turn, message)`` -> one row a message: kind, category, attribute, constraints.

    A first turn is an opening; all others are replies. ``category`` is what the message itself names.
    """
    rows = messages.withColumn("id", F.struct("session_id", "turn"))
    first = D.parse_openings(rows.where("turn <= 1").select("id", "message"), lookup)
    opened = first.select(
        "id.*", F.lit("opening").alias("kind"), "category", F.lit(None).cast("string").alias("attribute"), "constraints", "scenario", "exact"
    )
    later = rows.where("turn > 1").select("id", "message", D.parse_reply("message").alias("r"))
    named = D.scan_category(later.select("id", "message"), lookup)
    replied = later.join(named.hint("merge"), "id", "left").select(
        "id.*", "r.kind", F.col("name").alias("category"), "r.attribute", "r.constraints", F.lit(None).cast("string").alias("scenario"), "r.exact"
    )
    return opened.unionByName(replied)


def constraint_rows(acts: DataFrame, config: Config = Config()) -> DataFrame:
    """(session_id, added, pos, text, provisional, override_turn) of each constraint's first mention."""
    override = acts.where("kind = 'override'").groupBy("session_id").agg(F.min("turn").alias("override_turn"))
    rows = (
        acts.where(F.col("kind").isin("opening", "override", "disclosure"))
        .select("session_id", F.col("turn").alias("added"), "kind", F.posexplode("constraints").alias("pos", "text"))
        .withColumn("norm", T.normalise("text"))
        .where("norm <> ''")
        .join(override, "session_id", "left")
    )
    provisional = (F.col("kind") == "opening") & F.lit(config.use_override_erasure)
    era = F.when(F.lit(config.override_decay <= 0) & (F.col("added") >= F.col("override_turn")), 1).otherwise(0)
    rows = rows.withColumn("provisional", provisional).withColumn("era", era)
    first = Window.partitionBy("session_id", "norm", "era").orderBy("added", "pos")
    kept = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("session_id", "added", "pos", "text", "norm", "provisional", "override_turn", "era")


def state(messages: DataFrame, lookup: DataFrame, config: Config = Config(), pending: str = "other") -> dict[str, DataFrame]:
    """Relations of every session after every turn of its own.

    ``turns`` (session_id, turn, category, exhausted), ``constraints`` (session_id, turn, text, kind, value,
    attribute, weight, active, added, pos) and ``observed`` (session_id, turn, token: the turn that first
    held it). ``pending`` is the attribute asked before a reply that names none.
    """
    acts = checkpointed(parsed(messages, lookup))  # read by all relations below, parsed once
    order = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.when(F.col("kind").isin("no_additional", "boundary"), F.coalesce("attribute", F.lit(pending)))
    turns = acts.select(
        *KEYS,
        F.first("category", ignorenulls=True).over(order).alias("category"),
        F.array_sort(F.collect_set(spent).over(order)).alias("exhausted"),
    )
    rows = constraint_rows(acts, config)
    known = turns.select(*KEYS).join(rows, "session_id").where(F.col("added") <= F.col("turn"))
    over = F.coalesce(F.col("provisional") & (F.col("override_turn") <= F.col("turn")) & (F.col("override_turn") > F.col("added")), F.lit(False))
    k = T.classify_kind("text")
    if config.override_decay > 0:
        known = known.withColumn("weight", F.when(over, config.override_decay).otherwise(1.0)).withColumn("active", F.lit(True))
    else:
        known = known.withColumn("weight", F.lit(1.0)).withColumn("active", ~over)
        once = Window.partitionBy(*KEYS, "norm", "active").orderBy("added", "pos")
        known = known.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    constraints = known.select(
        *KEYS, "text", k["kind"].alias("kind"), k["value"].alias("value"), T.classify_constraint("text").alias("attribute"),
        "weight", "active", "added", "pos",
    )
    tokens = messages.select(*KEYS, F.explode(T.content_terms("message")).alias("token"))
    observed = tokens.groupBy("session_id", "token").agg(F.min("turn").alias("turn"))
    return {"acts": acts, "turns": turns, "constraints": constraints, "observed": observed}


def query_terms(found: dict[str, DataFrame], config: Config = Config()) -> DataFrame:
    """(session_id, token, boost) after each session's last turn.

    The largest of category, observed and constraint boosts; tokens of erased constraints that neither
    category nor an active constraint holds get the penalty instead.
    """
    last = found["turns"].groupBy("session_id").agg(F.max("turn").alias("turn"))
    turns = found["turns"].join(last, KEYS)
    constraints = found["constraints"].join(last, KEYS)
    category = turns.where("category IS NOT NULL").select(
        "session_id", F.explode(T.terms("category")).alias("token"), F.lit(config.category_term_boost).alias("boost"), F.lit(True).alias("protected")
    )
    observed = found["observed"].select("session_id", "token", F.lit(config.observed_term_boost).alias("boost"), F.lit(False).alias("protected"))
    active = constraints.where("active").select(
        "session_id", F.explode(T.terms("text")).alias("token"), (config.constraint_term_boost * F.col("weight")).alias("boost"), F.lit(True).alias("protected")
    )
    rows = category.unionByName(active)
    if config.use_observed_fallback and config.observed_term_boost > 0:
        rows = rows.unionByName(observed)
    best = rows.groupBy("session_id", "token").agg(F.max("boost").alias("boost"), F.max("protected").alias("protected"))
    erased = constraints.where("NOT active").select("session_id", F.explode(T.terms("text")).alias("token")).distinct().withColumn("erased", F.lit(True))
    both = best.join(erased, ["session_id", "token"], "full_outer")
    penal = F.col("erased").isNotNull() & ~F.coalesce("protected", F.lit(False))
    return both.select("session_id", "token", F.when(penal, F.lit(-abs(config.decoy_term_penalty))).otherwise(F.col("boost")).alias("boost"))
