"""The corpus pipeline: toxic documents go, near copies go, secrets are masked, sources are mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the
last return the columns of ``documents``, whatever others there are beside them. Between stages the rows are
written as Parquet in the shared folder and read again, so a lost executor repeats part of one stage at most.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables; what it
makes of them stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe, mixing, secrets, simhash, toxicity
from parlance.llm.common import fresh_path, removed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores below the threshold.

    Null and empty texts score as a text without words, which is clean; repeated rows go or stay together.
    Without labels nothing is toxic. An empty table stays empty.
    """
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    The least doc_id stays, a null one only if there is no other; of rows with one id the least text hash, of
    repeated rows one. Null and empty texts are one group. An empty table stays empty.
    """
    return simhash.deduplicated(docs, width=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets give way to a mark; every document stays.

    A null text stays null, an empty one empty; repeated rows are masked alike. An empty table stays empty.
    """
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn with raked weights, three quarters of all tokens or more.

    A null source or language is a value of its own; texts without words have no topic and no tokens. Rows of
    one id are drawn together, and all rows without an id too. An empty table stays empty.
    """
    return mixing.sampled(docs, mixing.Targets(least=0.75))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit), and whether they decode to it.

    (doc_id, lang, source, n_tokens, ids, round_trip), one row per row, repeated ones too. Null and empty texts
    have no ids. An empty table stays empty.
    """
    import public_tokenizers

    made = bpe.encode(
        docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    )
    whole = F.coalesce("text", F.lit("")).cast("binary") == F.col("decoded")
    return made.select("doc_id", "lang", "source", "n_tokens", "ids", whole.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: A conditional random field and a convolutional network have no SQL form; the stages are tested
#: against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table ``documents``.

    A stage's table is taken away once the next one stands; the last is read by the caller.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
