"""The conversation state as a keyed stream: one state a session, folded message by message.

A message's act does not depend on the messages before it, so acts are parsed by the same plans as in the
batch state, micro-batch by micro-batch; all that is kept for a session is the state the fold needs: the
acts of its latest turns. A message that comes late is put in its place by turn, and the turns after it are
folded anew, so the states are right in whatever order files arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.functions import vocabulary as V
from parlance.operators import state as ST
from parlance.sources.shared import broadcast_if_few

OUTPUT = "session_id bigint, turn int, kind string, category string, constraints string, exhausted string, revision int"
#: The acts of a session in order of turn: what the fold reads of each.
STATE = "turns array<int>, kinds array<string>, categories array<string>, attributes array<string>, constraints array<array<string>>, revision int"
_ACTS = "session_id bigint, turn int, kind string, category string, attribute string, constraints array<string>"
#: A session without a message for so long is over, and its state goes.
IDLE_MS = 24 * 3600 * 1000


def states(acts: list[tuple]) -> list[tuple[str | None, str, str]]:
    """(category, constraints, exhausted) after each of a session's acts (turn, kind, category, attribute, constraints).

    The rules are those of ``operators.state``: the first category named, constraints by their first mention,
    attributes spent by refusals.
    """
    category, known, seen, spent, out = None, [], set(), set(), []
    for _, kind, named, attribute, constraints in acts:
        category = category or named
        if kind in ("opening", "override", "disclosure"):
            for c in constraints:
                norm = " ".join(c.lower().split())
                if norm and norm not in seen:
                    seen.add(norm)
                    known.append(c)
        elif kind in ("no_additional", "boundary"):
            spent.add(attribute or V.OPEN)
        out.append((category, " | ".join(known), ",".join(sorted(spent))))
    return out


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """Put a session's new acts in their places; one row out for each turn from the first new one on."""
    columns = ["session_id", "turn", "kind", "category", "constraints", "exhausted", "revision"]
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([], columns=columns)
        return
    held = list(zip(*state.get[:5], strict=True)) if state.exists else []
    revision = state.get[5] + 1 if state.exists else 0
    new = [
        (int(r.turn), r.kind, r.category, r.attribute, list(r.constraints)) for rows in batches for r in rows.itertuples()
    ]
    acts = sorted({a[0]: a for a in [*held, *new]}.values(), key=lambda a: a[0])
    first = min(a[0] for a in new)
    out = [
        (key[0], a[0], a[1], *s, revision) for a, s in zip(acts, states(acts), strict=True) if a[0] >= first
    ]
    parts = [list(x) for x in zip(*acts, strict=True)]
    state.update((*parts[:4], [list(c) for c in parts[4]], revision))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(out, columns=columns)


def folded(acts: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """A stream of acts -> a stream of states: for each new act, its turn and all later ones of its session.

    ``idle_ms``: after so long without a message a session's state goes; None keeps it, for streams that end.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return fold(key, batches, state, idle_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return acts.groupBy("session_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def replay(messages: DataFrame, lookup: DataFrame, folder: str, files: int = 4) -> DataFrame:
    """Write messages as files, stream them until all are read, and return the last state of every turn.

    Two queries: the first parses each micro-batch of messages by the batch plans (openings, replies, the scan for
    categories), the second folds the acts. Files hold turns in no order; ``fold`` sorts that out.
    """
    spark, lookup = messages.sparkSession, broadcast_if_few(lookup)  # names are found once, not in every batch
    messages.repartition(files, "turn").write.mode("overwrite").parquet(f"{folder}/in")

    def parse(batch: DataFrame, number: int) -> None:
        acts = ST.parsed(batch, lookup).select(
            F.col("session_id").cast("bigint"), F.col("turn").cast("int"), "kind", "category", "attribute", "constraints"
        )
        acts.coalesce(4).write.mode("overwrite").parquet(f"{folder}/acts/{number}")  # a repeated batch writes the same

    def run(stream: DataFrame, name: str, sink) -> None:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True)
        sink(writer).awaitTermination()

    said = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run(said, "parse", lambda w: w.foreachBatch(parse).start())
    spark.createDataFrame([], _ACTS).write.parquet(f"{folder}/acts/none")
    spark.createDataFrame([], OUTPUT).write.parquet(f"{folder}/out")
    acts = spark.readStream.schema(_ACTS).option("maxFilesPerTrigger", 8).parquet(f"{folder}/acts/*")
    run(folded(acts, None), "fold", lambda w: w.format("parquet").option("path", f"{folder}/out").start())
    out = spark.read.schema(OUTPUT).parquet(f"{folder}/out")
    latest = F.max_by(F.struct("kind", "category", "constraints", "exhausted"), "revision").alias("s")
    return out.groupBy("session_id", "turn").agg(latest).select("session_id", "turn", "s.*")
