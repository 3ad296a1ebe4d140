"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, count). A run joins the digests of
its texts to it, encodes each distinct text that it lacks once, and appends what it found. Digests and ids
are what is grouped and joined. Texts leave their place only for texts that the cache lacks: if it lacks
none, no text is read; if what it lacks is small, its digests are broadcast to the texts; else the texts
meet the missing digests in one shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import pieces
from parlance.llm.common import checkpointed, fresh_path, per_batch, removed

#: Pieces whose counts a worker remembers, some 80 MB; a full memory is emptied.
MEMORY = 500_000
#: Missing digests that are broadcast at most (some 100 bytes each), if they are a tenth of all at most.
FEW, FEW_SHARE = 200_000, 0.1


def tokenizer_digest(path: str) -> str:
    """The tokenizer's version: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def splits_like_bytes(about: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE over unchanged text, so that pieces may be counted on their own."""
    split = about.get("pre_tokenizer") or {}
    return (
        about.get("model", {}).get("type") in (None, "BPE") and about.get("normalizer") is None
        and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    )


class JsonCounter:
    """Counts as ``tokenizers`` gives them for a .json file.

    In byte-level BPE merges never cross pieces, and a piece on its own is split into itself, so a text's
    count is the sum over its pieces, each encoded by the library once. A text that holds one of the added
    tokens goes to the library whole, which then applies its default handling of them; so does every text
    if the file is of another sort.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_piece = splits_like_bytes(json.load(f))
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self._whole(texts)
        known, out = self.known, [0] * len(texts)
        if len(known) > MEMORY:
            known.clear()
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        for i, n in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = n
        skip = set(whole)
        split = {i: pieces.split(t) for i, t in enumerate(texts) if i not in skip}
        new = list({p for found in split.values() for p in found if p not in known})
        known.update(zip(new, self._whole(new), strict=True))
        for i, found in split.items():
            out[i] = sum(map(known.__getitem__, found))
        return out


class PieceCounter:
    """Counts as ``sentencepiece`` gives them for a .model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]


@lru_cache(maxsize=4)
def counter(path: str) -> JsonCounter | PieceCounter:
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def _read(spark, cache: str, version: str) -> DataFrame | None:
    try:
        return spark.read.parquet(cache).where(F.col("tokenizer") == version).select("digest", "cached")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512, few: int = FEW) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row.

    ``cache``: path of the cache, made if there is none; it must be in storage that all executors
    share. Content is normalised only as far as every tokenizer's counts allow: a null becomes the
    empty text. Null doc_ids and repeated rows stay. Columns other than doc_id and text are not read. An
    empty table gives an empty result. An append that fails and is retried can leave a text in the cache
    twice; readers take one.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    rows = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.unhex(digest).alias("digest"),
        )
    )
    stored = _read(spark, cache, version)
    distinct = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    if stored is not None:
        distinct = distinct.join(stored.select("digest", F.lit(True).alias("held")).distinct(), "digest", "left")
    else:
        distinct = distinct.withColumn("held", F.lit(None).cast("boolean"))
    keys = ["digest", "rep", "rep_null"]
    distinct = checkpointed(distinct.select("digest", F.coalesce("rep", F.lit(0)).alias("rep"), F.col("rep").isNull().alias("rep_null"), "held"))
    missing, every = distinct.agg(F.count_if(F.col("held").isNull()), F.count("*")).first()
    if missing:
        misses = distinct.where("held IS NULL").select(*keys)
        if missing <= few and missing <= FEW_SHARE * every:
            misses = F.broadcast(misses)
        full = docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("rep"),
            F.col("doc_id").isNull().alias("rep_null"),
            F.unhex(digest).alias("digest"),
            text.alias("text"),
        )
        # Joined on the row's id too, so that the copies of one text are dealt out evenly. Rows of one id and
        # text are then together already, and one of them stays.
        chosen = full.join(misses, keys, "left_semi").dropDuplicates(keys).select("digest", "text")

        def over(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = counter(tokenizer).counts(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.int64())], ["digest", "cached"])

        counted = per_batch(chosen, over, "digest binary, cached long")
        counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    known = _read(spark, cache, version)
    if known is None:  # nothing was written, as there are no texts
        known = spark.createDataFrame([], "digest binary, cached long")
    # Only counts of texts at hand, fixed by a checkpoint: they meet the rows in a plain join, in which Spark splits
    # the copies of one text that would otherwise all go to one task.
    known = known.join(distinct.select("digest"), "digest", "left_semi")
    known = checkpointed(known.groupBy("digest").agg(F.max("cached").alias("n_tokens")))
    return rows.join(known, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def query(docs: DataFrame) -> DataFrame:
    """The rows of query op2.

    The cache is new for each run, so that no run leans on another's. The table arrives in two parts, dealt out
    by a hash of the ids; the second meets a cache that the first has filled, so texts of which both hold copies
    are encoded once.
    """
    import public_tokenizers

    path, spark = public_tokenizers.path("byte_bpe_50k.json"), docs.sparkSession
    cache = fresh_path(spark, "token-counts")
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2))
    first, second = (token_counts(docs.where(part == k), path, cache) for k in (0, 1))
    removed(spark, cache)  # both results hold their counts by now
    return first.unionByName(second)
