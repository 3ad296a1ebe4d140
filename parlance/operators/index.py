"""The inverted index: weighted postings, document lengths, vocabulary, statistics, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions import vocabulary as V


def weighted_postings(products: DataFrame, weights=V.FIELD_WEIGHTS, key: str = "parent_asin") -> DataFrame:
    """(doc, token, wtf): the sum of field weights over a token's occurrences. One shuffle, map-side combined."""
    fields = F.array(
        *(F.struct(F.lit(float(w)).alias("w"), T.terms(T.FIELD_TEXT[name]()).alias("tokens")) for name, w in weights)
    )
    rows = products.select(F.col(key).alias("doc"), F.explode(fields).alias("f"))
    return (
        rows.select("doc", "f.w", F.explode("f.tokens").alias("token")).groupBy("doc", "token").agg(F.sum("w").alias("wtf"))
    )


def corpus_postings(corpus: DataFrame) -> DataFrame:
    """(doc, token, wtf) of plain texts, each occurrence weighing one."""
    return (
        corpus.select("doc", F.explode(T.terms("text")).alias("token"))
        .groupBy("doc", "token")
        .agg(F.count("*").cast("double").alias("wtf"))
    )


def doc_lengths(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, len): the sum of a document's postings; 0 for one without tokens."""
    lengths = postings.groupBy("doc").agg(F.sum("wtf").alias("len"))
    return docs.select("doc").join(lengths, "doc", "left").select("doc", F.coalesce("len", F.lit(0.0)).alias("len"))


def text_lengths(corpus: DataFrame) -> DataFrame:
    """(doc, len) of plain texts: the number of their terms, without postings."""
    return corpus.groupBy("doc").agg(F.sum(F.size(T.terms("text"))).cast("double").alias("len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n documents and their mean length, 1.0 if there is none."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len"))


def vocabulary(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln(1 + (n - df + 0.5) / (df + 0.5))."""
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    one = stats.select(F.col("n").alias("_n"))  # a single row
    return df.crossJoin(F.broadcast(one)).select(
        "token", "df", F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )


def frequent(vocab: DataFrame, min_df: int = 2) -> DataFrame:
    return vocab.where(F.col("df") >= min_df)


def product_index(products: DataFrame) -> DataFrame:
    """One row a product with all that ranking reads: flat text, attributes, numbers, category."""
    blob = T.match_text(T.searchable_text())
    flat = products.withColumn("blob", blob)
    return flat.select(
        "parent_asin", "title", "blob", T.coarse_category("categories").alias("category"),
        T.material_hits("blob").alias("materials"), T.first_material("blob").alias("first_material"),
        T.color_hits("blob").alias("colors"), T.first_color("blob").alias("first_color"),
        T.parse_price("price").cast("float").cast("double").alias("price"),
        F.coalesce(F.col("average_rating").cast("float").cast("double"), F.lit(0.0)).alias("rating"),
        F.coalesce("rating_number", F.lit(0)).cast("bigint").alias("rating_number"),
        F.array_distinct(T.terms("title")).alias("title_tokens"),
    )


def popularity_scale(index: DataFrame) -> DataFrame:
    """One row: ln(1 + the largest rating count), or 1 if that is zero."""
    top = F.log1p(F.max("rating_number").cast("double"))
    return index.agg(F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0)).alias("scale"))


def with_popularity(index: DataFrame) -> DataFrame:
    """``index`` with popularity = 0.65 ln(1 + ratings) / scale + 0.35 rating / 5."""
    return index.crossJoin(F.broadcast(popularity_scale(index))).withColumn(
        "popularity",
        0.65 * F.log1p(F.col("rating_number").cast("double")) / F.col("scale") + 0.35 * F.col("rating") / 5.0,
    ).drop("scale")


def category_buckets(index: DataFrame) -> DataFrame:
    return index.groupBy("category").agg(F.count("*").alias("size"), F.min("parent_asin").alias("first_asin"))


def bucket_lookup(index: DataFrame) -> DataFrame:
    """(norm_name, name) of categories; of names that normalise alike the last in order stays."""
    names = index.select(T.normalise("category").alias("norm_name"), F.col("category").alias("name")).distinct()
    last = Window.partitionBy("norm_name").orderBy(F.desc("name"))
    return names.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
