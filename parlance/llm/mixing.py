"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Token totals of the cells (source, language, topic) are raked until their sums over each dimension
meet its target shares. Topics are learnt from the corpus: its key words are the ``Topics.words`` most
frequent of those that stand in a middling share of all documents, and a document's topic is the key
word that it uses most for how common it is. A document's weight is that of its cell; its sampling
probability is the weight scaled so that the heaviest cell is taken whole, so no probability is capped
and the expected token shares are exactly the raked ones. That way the rarest cell decides how much is
kept; with ``Targets.least`` a share of all tokens is kept at least: the weights are scaled up until the
rest makes up for the cells that are taken whole, and ``deviation`` tells how far the shares then are from
the raked ones. Draws are hashes of the ids: the same on any cluster, and after any executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parlance.llm.common import BATCH_ROWS, checkpointed, per_batch

DIMENSIONS = ("source", "lang", "topic")
#: Cells that are raked on the driver and broadcast at most: under 20 MB. More are raked as a table.
MAX_CELLS = 100_000
_WORD, _KEY_WORD = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D.,;:!?]+"
_POINTS = bytes.maketrans(b".,;:!?", b" " * 6)
#: The topic of a document without a key word; no word has a space.
NO_TOPIC = "no topic"
#: Words that a task counts before it passes them on.
_HELD = 300_000


@dataclass(frozen=True)
class Targets:
    """Target shares by dimension.

    ``power``: a dimension's shares are its present ones to this power, made to sum to one (below 1
    evens them out, 1 keeps them). ``shares``: explicit shares instead; values not named keep their
    present share of what is left. ``least``: the share of all tokens to keep, or more (in expectation).
    """

    power: dict[str, float] = field(default_factory=lambda: {"source": 0.8, "lang": 0.8, "topic": 0.8})
    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    rounds: int = 12
    seed: str = "mix-1"
    least: float = 0.0


@dataclass(frozen=True)
class Topics:
    """Key words: so many, each in at least one of ``rarest`` documents and at most one of ``commonest``."""

    words: int = 64
    rarest: int = 200
    commonest: int = 20


def key_words(docs: DataFrame, topics: Topics = Topics()) -> dict[bytes, int]:
    """The key words of ``docs(text)`` and the number of documents that hold each, over all documents.

    Each task counts its own documents first; what meets in the shuffle is one row a task and word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            made = [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(made, ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in set((text or "").encode().translate(_POINTS).split()):
                    held[w] = held.get(w, 0) + 1
            if len(held) > _HELD:
                yield out()
        if held:
            yield out()

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    every = docs.count()
    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    found = seen.groupBy("word").agg(F.sum("n").alias("n"))
    band = found.where((F.col("n") * topics.rarest >= every) & (F.col("n") * topics.commonest <= every))
    return {r.word.encode(): r.n for r in band.orderBy(F.desc("n"), "word").limit(topics.words).collect()}


def described(text: str | None, words: dict[bytes, int]) -> tuple[str, int]:
    """(topic, tokens) of a text: the key word with the most uses over its documents, ties to the smaller; and the
    words between white space."""
    raw, uses = (text or "").encode(), {}
    for w in filter(words.__contains__, raw.translate(_POINTS).split()):
        uses[w] = uses.get(w, 0) + 1
    best = min(uses, key=lambda w: (-(uses[w] / words[w]), w), default=None)
    return (NO_TOPIC if best is None else best.decode()), len(raw.split())


def _cells_of(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """``docs(doc_id, text, lang, source)`` -> (doc_id, _source, _lang, _topic, _tokens), one row per row."""

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        topic, tokens = zip(*(described(t, words) for t in batch.column("text").to_pylist()))
        made = [pa.array(topic, pa.string()), pa.array(tokens, pa.int64())]
        kept = [batch.column(c) for c in ("doc_id", "_source", "_lang")]
        return pa.RecordBatch.from_arrays(kept + made, ["doc_id", "_source", "_lang", "_topic", "_tokens"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("_source"),
        F.col("lang").cast("string").alias("_lang"), F.col("text").cast("string").alias("text"),
    )
    return per_batch(rows, over, "doc_id long, _source string, _lang string, _topic string, _tokens long")


def _targets(values: list, totals: np.ndarray, dimension: str, targets: Targets) -> np.ndarray:
    share = totals / totals.sum() if totals.sum() else np.full(len(totals), 1 / max(1, len(totals)))
    named = targets.shares.get(dimension)
    if named:
        fixed = np.array([named.get(v, np.nan) for v in values], float)
        rest = np.isnan(fixed)
        left = max(0.0, 1 - np.nansum(fixed))
        fixed[rest] = left * share[rest] / max(share[rest].sum(), 1e-300)
        return fixed
    raised = share ** targets.power.get(dimension, 1.0)
    return raised / raised.sum()


def rake(codes: list[np.ndarray], totals: np.ndarray, shares: list[np.ndarray], rounds: int) -> np.ndarray:
    """Weights of cells. codes: each cell's value number in each dimension; shares: target share of each value."""
    weight, whole = np.ones(len(totals)), totals.sum()
    for _ in range(rounds):
        for code, share in zip(codes, shares, strict=True):
            now = np.bincount(code, totals * weight, len(share))
            factor = np.divide(share * whole, now, out=np.ones(len(share)), where=now > 0)
            weight = weight * factor[code]
    return weight


def scale(totals: np.ndarray, weight: np.ndarray, least: float) -> float:
    """The factor from weights to probabilities (at most 1 each): the heaviest cell is just taken whole, or more
    so that ``least`` of all tokens are kept."""
    held = (totals > 0) & (weight > 0)
    if not held.any():
        return 1.0
    t, w = totals[held], weight[held]
    factor, whole = 1.0 / w.max(), np.zeros(len(w), bool)
    # Cells that become whole leave a goal to the others, until no more of them become whole.
    while not whole.all():
        factor = max(factor, (least * t.sum() - t[whole].sum()) / (t * w)[~whole].sum())
        more = whole | (factor * w >= 1)
        if (more == whole).all():
            break
        whole = more
    return float(factor)


def _table_scale(state: DataFrame, least: float) -> float:
    """``scale`` for any number of cells."""
    held = state.where("_tokens > 0 AND _weight > 0")
    top, total = held.agg(F.max("_weight"), F.sum("_tokens")).first()
    if not top:
        return 1.0
    factor, before = 1.0 / top, -1
    while True:  # as above; from the cells that are whole by the last factor
        whole = F.col("_weight") * F.lit(factor) >= 1
        taken, rest, count = held.agg(
            F.coalesce(F.sum(F.when(whole, F.col("_tokens"))), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(~whole, F.col("_tokens") * F.col("_weight"))), F.lit(0.0)),
            F.count_if(whole),
        ).first()
        if not rest or count == before:
            return factor
        factor, before = max(factor, (least * total - taken) / rest), count


def _raked_table(cells: DataFrame, targets: Targets) -> DataFrame:
    """The same weights for any number of cells, with a checkpoint after each round."""
    whole = cells.agg(F.sum("_tokens")).first()[0] or 0
    wanted = {}
    for d in DIMENSIONS:
        name, named = f"_{d}", targets.shares.get(d)
        per = cells.groupBy(name).agg(F.sum("_tokens").alias("t"))
        share = F.col("t") / F.lit(float(max(whole, 1)))
        if named:
            given = F.element_at(F.create_map(*(F.lit(x) for kv in named.items() for x in kv)), F.coalesce(name, F.lit("")))
            per = per.select(name, share.alias("share"), given.alias("given"))
            left, free = per.agg(
                F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("given"), F.lit(0.0))),
                F.sum(F.when(F.col("given").isNull(), F.col("share"))),
            ).first()
            goal = F.coalesce("given", F.col("share") * F.lit(left / max(free or 0.0, 1e-300)))
        else:
            raised = F.pow(share, F.lit(targets.power.get(d, 1.0)))
            per = per.select(name, raised.alias("share"))
            goal = F.col("share") / F.lit(per.agg(F.sum("share")).first()[0] or 1.0)
        wanted[d] = checkpointed(per.select(F.col(name).alias(f"{name}_key"), goal.alias("goal")))
    state = cells.withColumn("_weight", F.lit(1.0))
    for _ in range(targets.rounds):
        for d in DIMENSIONS:
            name = f"_{d}"
            now = state.groupBy(F.col(name).alias("now_key")).agg(F.sum(F.col("_tokens") * F.col("_weight")).alias("now"))
            factor = now.join(wanted[d], F.col("now_key").eqNullSafe(F.col(f"{name}_key"))).select(
                "now_key",
                F.when(F.col("now") > 0, F.col("goal") * float(whole) / F.col("now")).otherwise(1.0).alias("f"),
            )
            state = state.join(factor, F.col(name).eqNullSafe(F.col("now_key"))).select(
                *cells.columns, (F.col("_weight") * F.col("f")).alias("_weight")
            )
        state = checkpointed(state)
    return state


def cell_weights(rows: DataFrame, targets: Targets, max_cells: int = MAX_CELLS) -> DataFrame:
    """(_source, _lang, _topic, _weight, _probability) of every cell; broadcast if bounded."""
    names = [f"_{d}" for d in DIMENSIONS]
    cells = rows.groupBy(*names).agg(F.sum("_tokens").alias("_tokens"))
    few = cells.limit(max_cells + 1).collect()
    spark = rows.sparkSession
    schema = ", ".join([*(f"{n} string" for n in names), "_weight double, _probability double"])
    if len(few) > max_cells:
        state = _raked_table(checkpointed(cells), targets)
        factor = _table_scale(state, targets.least)
        return state.select(*names, "_weight", F.least(F.col("_weight") * F.lit(factor), F.lit(1.0)).alias("_probability"))
    if not few:
        return spark.createDataFrame([], schema)
    few.sort(key=lambda r: tuple((r[n] is not None, r[n] or "") for n in names))
    totals, codes, shares = np.array([float(r["_tokens"]) for r in few]), [], []
    for d, name in zip(DIMENSIONS, names, strict=True):
        values: dict = {}
        codes.append(np.array([values.setdefault(r[name], len(values)) for r in few]))
        shares.append(_targets(list(values), np.bincount(codes[-1], totals, len(values)), d, targets))
    weight = rake(codes, totals, shares, targets.rounds)
    factor = scale(totals, weight, targets.least)
    made = [
        (*(r[n] for n in names), float(w), float(min(1.0, w * factor))) for r, w in zip(few, weight, strict=True)
    ]
    return F.broadcast(spark.createDataFrame(made, schema))


def _weighted(rows: DataFrame, cells: DataFrame, targets: Targets) -> DataFrame:
    """``rows(doc_id, _source, _lang, _topic)`` with _weight, _probability and _sampled."""
    names = [f"_{d}" for d in DIMENSIONS]
    cells = cells.withColumnsRenamed({n: f"{n}_cell" for n in names})
    met = [F.col(n).eqNullSafe(F.col(f"{n}_cell")) for n in names]
    draw = F.conv(
        F.substring(F.md5(F.concat(F.lit(f"{targets.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 8),
        16, 10,
    ).cast("double") / F.lit(2.0**32)
    return rows.join(cells, met[0] & met[1] & met[2]).withColumn("_sampled", draw < F.col("_probability"))


def mix(docs: DataFrame, targets: Targets = Targets(), max_cells: int = MAX_CELLS, topics: Topics = Topics()) -> DataFrame:
    """``docs(doc_id, text, lang, source)`` -> one row per row with its weight and whether it is drawn.

    doc_id, source, lang, topic, n_tokens, weight, probability, sampled. A null source or language is a
    value of its own; a null or empty text has no tokens and NO_TOPIC. Rows of one doc_id share their draw;
    all null ids share one. Without tokens all weights are 1. Columns of other names are not read. An empty
    table gives an empty result.
    """
    rows = checkpointed(_cells_of(docs, key_words(docs, topics)))
    return _weighted(rows, cell_weights(rows, targets, max_cells), targets).select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("weight"),
        F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"),
    )


def sampled(docs: DataFrame, targets: Targets = Targets(), max_cells: int = MAX_CELLS, topics: Topics = Topics()) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns kept, whatever their names. Nulls and repeats as in ``mix``."""
    words = key_words(docs, topics)
    cells = cell_weights(checkpointed(_cells_of(docs, words)), targets, max_cells)
    names = [n.lower() for n in docs.columns]
    place = {n: names.index(n) for n in ("doc_id", "text", "lang", "source")}

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column("row")
        topic = [described(t, words)[0] for t in row.field(place["text"]).to_pylist()]
        return pa.RecordBatch.from_arrays([row, pa.array(topic, pa.string())], ["row", "_topic"])

    # The whole row travels as one struct, so no name of its columns can clash.
    schema = StructType([StructField("row", docs.schema), StructField("_topic", StringType())])
    rows = per_batch(docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row")), over, schema)
    own = {n: F.col("row")[docs.columns[place[n]]] for n in ("doc_id", "lang", "source")}
    rows = rows.select(
        "row", own["doc_id"].cast("long").alias("doc_id"), own["source"].cast("string").alias("_source"), own["lang"].cast("string").alias("_lang"), "_topic"
    )
    return _weighted(rows, cells, targets).where("_sampled").select("row.*")


def deviation(docs: DataFrame, targets: Targets = Targets(), max_cells: int = MAX_CELLS, topics: Topics = Topics()) -> DataFrame:
    """One row: kept_docs and kept_tokens, the expected shares that are drawn, and moved, the share of the drawn
    tokens that is in other cells than by the raked weights (0 without ``Targets.least``)."""
    rows = checkpointed(_cells_of(docs, key_words(docs, topics)))
    cells = _weighted(rows, cell_weights(rows, targets, max_cells), targets).groupBy(*(f"_{d}" for d in DIMENSIONS)).agg(
        F.count("*").alias("docs"), F.sum("_tokens").alias("t"), F.first("_weight").alias("w"), F.first("_probability").alias("p")
    )
    sums = cells.agg(F.sum(F.col("t") * F.col("w")).alias("tw"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    return cells.crossJoin(F.broadcast(sums)).agg(
        (F.sum(F.col("docs") * F.col("p")) / F.sum("docs")).alias("kept_docs"),
        (F.sum(F.col("t") * F.col("p")) / F.sum("t")).alias("kept_tokens"),
        (F.sum(F.abs(F.col("t") * F.col("w") / F.col("tw") - F.col("t") * F.col("p") / F.col("tp"))) / 2).alias("moved"),
    )


def query(docs: DataFrame) -> DataFrame:
    """The rows of query op10."""
    return mix(docs)


def _oracle(targets: Targets = Targets(), topics: Topics = Topics()) -> str:
    """The same rows in SQL, every raking step a common table of its own."""
    steps = [
        "d0 AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS text FROM documents)",
        f"tf AS MATERIALIZED (SELECT r, word, count(*) AS uses FROM (SELECT r, unnest(regexp_extract_all(text, '{_KEY_WORD}')) AS word FROM d0) GROUP BY ALL)",
        "key AS MATERIALIZED (SELECT word, count(*) AS docs FROM tf GROUP BY 1 "
        f"HAVING count(*) * {topics.rarest} >= (SELECT count(*) FROM d0) AND count(*) * {topics.commonest} <= (SELECT count(*) FROM d0) "
        f"ORDER BY docs DESC, word LIMIT {topics.words})",
        "best AS (SELECT r, word AS topic FROM tf JOIN key USING (word) QUALIFY row_number() OVER (PARTITION BY r ORDER BY uses::DOUBLE / docs DESC, word) = 1)",
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(topic, '{NO_TOPIC}') AS topic, "
        f"coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS n FROM d0 LEFT JOIN best USING (r))",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS t, 1.0::DOUBLE AS w FROM d GROUP BY ALL)",
    ]
    for dim in DIMENSIONS:
        power = targets.power[dim]
        steps.append(f"s_{dim} AS (SELECT {dim}, pow(sum(t) / (SELECT sum(t) FROM c0), {power}) AS g FROM c0 GROUP BY 1)")
        steps.append(f"g_{dim} AS MATERIALIZED (SELECT {dim}, g / (SELECT sum(g) FROM s_{dim}) AS goal FROM s_{dim})")
    at = 0
    for _ in range(targets.rounds):
        for dim in DIMENSIONS:
            steps.append(
                f"c{at + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.t, "
                f"c.w * g.goal * (SELECT sum(t) FROM c0) / sum(c.t * c.w) OVER (PARTITION BY c.{dim}) AS w "
                f"FROM c{at} c JOIN g_{dim} g ON c.{dim} IS NOT DISTINCT FROM g.{dim})"
            )
            at += 1
    same = " AND ".join(f"d.{x} IS NOT DISTINCT FROM c.{x}" for x in DIMENSIONS)
    probability = f"least(1.0, c.w / (SELECT max(w) FROM c{at} WHERE t > 0))"
    draw = f"('0x' || substr(md5('{targets.seed}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT d.doc_id, d.source, d.lang, d.topic, d.n AS n_tokens, round(c.w, 6) AS weight, "
        f"round({probability}, 6) AS probability, {draw} < {probability} AS sampled FROM d JOIN c{at} c ON {same}"
    )


ORACLE_SQL = _oracle()
