"""BM25 over postings, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions import vocabulary as V
from parlance.operators import index as I
from parlance.sources.shared import broadcast_if_few, checkpointed


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, token, boost): each query's distinct terms at weight one."""
    return queries.select("query", F.explode(F.array_distinct(T.terms("text"))).alias("token"), F.lit(1.0).alias("boost"))


def bm25(
    terms: DataFrame, postings: DataFrame, lengths: DataFrame, vocab: DataFrame, stats: DataFrame,
    pool: DataFrame | None = None, members: DataFrame | None = None, k1: float = V.BM25_K1, b: float = V.BM25_B,
) -> DataFrame:
    """``terms(query, token, boost)`` -> (query, doc, score), summed over matching postings.

    The few tokens that queries hold meet the vocabulary first; postings are then reduced by an equi
    join on the token, so terms that no query holds never travel further. Postings and lengths that are dealt out
    by document stay where they are: scores are summed, and the best of them chosen, task by task.
    ``pool(query, category)`` with ``members(doc, category)`` keeps only documents of a query's categories.
    Terms of boost 0 are passed over.
    """
    asked = broadcast_if_few(terms.where("boost <> 0").join(vocab.select("token", "idf"), "token"))
    known = postings.join(lengths.hint("shuffle_hash"), "doc")
    hits = known.join(asked, "token").crossJoin(F.broadcast(stats.select("avg_len")))
    norm = F.col("wtf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    part = F.col("idf") * F.col("boost") * F.col("wtf") * (k1 + 1) / norm
    scores = hits.groupBy("query", "doc").agg(F.sum(part).alias("score"))
    if pool is None:
        return scores
    return scores.join(members.hint("shuffle_hash"), "doc").join(pool, ["query", "category"], "left_semi").select("query", "doc", "score")


def search(terms: DataFrame, postings: DataFrame, lengths: DataFrame, **only: DataFrame) -> DataFrame:
    """``bm25`` whose vocabulary is counted over the postings of asked tokens alone."""
    tokens = broadcast_if_few(terms.select("token").distinct())
    held, stats = postings.join(tokens, "token", "left_semi"), I.corpus_stats(lengths)
    return bm25(terms, held, lengths, I.vocabulary(held, stats), stats, **only)


def top_k(scores: DataFrame, k: int = 10, by: str = "score", digits: int = 6) -> DataFrame:
    """The first k of each query by rounded score, ties by document. Spark prunes to k rows before the shuffle."""
    ranked = scores.withColumn(by, F.round(by, digits))
    window = Window.partitionBy("query").orderBy(F.desc(by), "doc")
    return ranked.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def profiles(terms: DataFrame, postings: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that hold the same asked tokens equally often and are equally long have the same scores: they are one
    profile. ``(profile, query, score)`` and ``(doc, profile)``, a profile being the length and the tokens."""
    tokens = broadcast_if_few(terms.select("token").distinct())
    held, stats = postings.join(tokens, "token", "left_semi"), I.corpus_stats(lengths)
    asked = held.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("token", "wtf"))).alias("held"))  # asked tokens alone
    docs = asked.join(lengths.hint("shuffle_hash"), "doc").select("doc", F.struct("len", "held").alias("profile"))
    each = checkpointed(docs.groupBy("profile").agg(F.count("*").alias("docs")))
    one = each.select(F.to_json("profile").alias("doc"), "profile")
    parts = each.select(F.to_json("profile").alias("doc"), F.explode("profile.held").alias("h")).select("doc", "h.token", "h.wtf")
    vocab = I.vocabulary(held, stats)
    scores = bm25(terms, parts, one.select("doc", F.col("profile.len").alias("len")), vocab, stats)
    return scores.join(one, "doc").select("profile", "query", "score"), docs


def normalised(scores: DataFrame, few: bool = False) -> DataFrame:
    """Scores over the largest of their query; all 0 if that is not above 0. ``few``: queries were counted and can be
    broadcast, so that scores stay where they are."""
    top = scores.groupBy("query").agg(F.max("score").alias("_top"))
    rows = scores.join(F.broadcast(top) if few else top, "query")
    return rows.withColumn("lexical", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(0.0)).drop("_top")


#: Letters of a word by which a part of it is looked up.
_LETTERS = 3


def _keys(word: Column, kinds: set[str]) -> Column:
    """The keys (kind, key) under which a word of a text is found: the word, its ends, its beginnings, what it holds."""
    size = F.length(word)
    some = lambda make: F.transform(F.sequence(F.lit(1), F.least(F.lit(_LETTERS), size)), make)
    grams = F.flatten(some(lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substring(word, i, k))))
    found = {
        "is": F.array(word), "end": some(lambda k: F.substring(word, size - k + 1, k)),
        "start": some(lambda k: F.substring(word, F.lit(1), k)), "in": F.array_distinct(grams),
    }
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key"))
    return F.concat(*(F.transform(keys, named(kind)) for kind, keys in found.items() if kind in kinds))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """``needles(needle)``, ``texts(doc, text)`` -> (needle, doc) where the needle is a substring of the text. Both hold
    words with single spaces between them.

    No needle meets every text or every word: its inner words are whole words of the text, its first word ends one and
    its last begins one; the only word of a needle is part of one. Each of these is looked up by an equi join on the word
    or its first or last letters, and that which the fewest texts hold gives the candidates. Candidates are verified.
    Texts that are dealt out by document stay where they are.
    """
    held = texts.select("doc", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    parts, n = F.split("needle", " "), F.size(F.split("needle", " "))
    kind = lambda i: F.when(n == 1, "in").when(i == 0, "end").when(i == n - 1, "start").otherwise("is")
    options = needles.where("needle <> ''").select("needle", F.posexplode(F.transform(parts, lambda w, i: F.struct(kind(i).alias("kind"), w.alias("part")))).alias("pos", "o"))
    short = F.least(F.lit(_LETTERS), F.length("part"))
    key = F.when(F.col("kind") == "is", F.col("part")).when(F.col("kind") == "end", F.substring("part", F.length("part") - short + 1, short)).otherwise(F.substring("part", F.lit(1), short))
    options = broadcast_if_few(options.select("needle", "pos", "o.*").withColumn("key", key))
    kinds = {r.kind for r in options.select("kind").distinct().collect()}  # four at most
    if not kinds:
        return held.select(F.lit("").alias("needle"), "doc").limit(0)
    words = held.where("word <> ''").groupBy("word").agg(F.count("*").alias("df"))
    fits = (
        F.when(F.col("kind") == "is", F.col("word") == F.col("part")).when(F.col("kind") == "end", F.endswith("word", F.col("part")))
        .when(F.col("kind") == "start", F.startswith("word", F.col("part"))).otherwise(F.contains("word", F.col("part")))
    )
    spots = words.select("word", "df", F.explode(_keys(F.col("word"), kinds)).alias("k")).select("word", "df", "k.*")
    spots = broadcast_if_few(spots.join(options, ["kind", "key"]).where(fits).select("needle", "pos", "word", "df"))
    cost = options.join(spots.groupBy("needle", "pos").agg(F.sum("df").alias("cost")), ["needle", "pos"], "left")
    least = cost.groupBy("needle").agg(F.min_by("pos", F.struct(F.coalesce("cost", F.lit(0)), "pos")).alias("pos"))
    chosen = broadcast_if_few(spots.join(least, ["needle", "pos"]).select("needle", "word"))
    found = held.join(chosen, "word").select("needle", "doc").distinct()
    return found.join(texts.hint("shuffle_hash"), "doc").where(F.contains("text", F.col("needle"))).select("needle", "doc")
