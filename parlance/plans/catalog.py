"""Queries on text functions, sources and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions import vocabulary as V
from parlance.operators import index as I
from parlance.plans import sql as S
from parlance.sources import adapters as A


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents")


def normalise_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalise("text").alias("norm"))


def match_text_flatten(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.match_text("text").alias("flat"))


def tokenize_terms(spark, sf_dir):
    t = T.terms("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("bigint").alias("n_terms"), F.array_join(t, " ").alias("terms"))


def searchable_blob(spark, sf_dir):
    p = A.products(spark, sf_dir)
    return p.select("parent_asin", T.searchable_text().alias("searchable"), T.match_text(T.searchable_text()).alias("blob"))


def coarse_category(spark, sf_dir):
    extra = F.array(F.lit("Clothing, Shoes & Jewelry"), F.col("store"), F.concat("store", F.lit(", "), "title"))
    return A.products(spark, sf_dir).select(
        "parent_asin", T.coarse_category("categories").alias("category"), T.coarse_category(extra).alias("long_path"),
        T.coarse_category(F.array(F.lit("Clothing"))).alias("root_only"),
    )


def flatten_details(spark, sf_dir):
    flat = T.flatten_map("details")
    return A.products(spark, sf_dir).select("parent_asin", F.array_join(flat, "; ").alias("flat"), F.size(flat).cast("bigint").alias("n"))


def _constraints(spark, sf_dir):
    """Constraint strings of every branch, one for each product."""
    made = F.array(
        F.concat(F.lit("color: "), F.coalesce(F.lit(None), F.element_at(F.split("title", " "), 1))), F.lit("budget around $25"),
        F.concat(F.lit("under "), F.col("rating_number").cast("string")), F.get("features", F.lit(1)), F.get("features", F.lit(2)),
        F.concat("title", F.lit(" covered")), F.lit("Wool"), F.lit("GREY"), F.concat(F.lit("gym "), "title"), F.col("title"),
    )
    p = A.products(spark, sf_dir).select("parent_asin", F.posexplode(made).alias("pos", "text"))
    return p.where("text IS NOT NULL").select("parent_asin", F.col("pos").cast("bigint").alias("pos"), "text")


_CONSTRAINTS_SQL = f"""WITH {A.PRODUCTS_SQL}, c AS (SELECT parent_asin, unnest(['color: ' || string_split(title, ' ')[1], 'budget around $25',
  'under ' || rating_number, features[2], features[3], title || ' covered', 'Wool', 'GREY', 'gym ' || title, title]) AS text,
  unnest(range(10)) AS pos FROM product) """


def classify_constraint(spark, sf_dir):
    return _constraints(spark, sf_dir).withColumn("attribute", T.classify_constraint("text"))


def classify_kind(spark, sf_dir):
    return _constraints(spark, sf_dir).withColumn("k", T.classify_kind("text")).select("parent_asin", "pos", "text", "k.kind", "k.value")


def parse_price(spark, sf_dir):
    p = A.products(spark, sf_dir)
    texts = F.array("price", F.concat(F.lit("from "), "price"), F.lit("1,299"), F.lit("$ 12.5 or 9"), F.lit("free"), F.lit("0"), F.lit("19.99"))
    rows = p.select("parent_asin", F.posexplode(texts).alias("pos", "text"))
    return rows.select("parent_asin", F.col("pos").cast("bigint").alias("pos"), T.parse_price("text").alias("price"))


def attribute_hits(spark, sf_dir):
    i = I.product_index(A.products(spark, sf_dir))
    return i.select("parent_asin", F.array_join("materials", ",").alias("materials"), F.array_join("colors", ",").alias("colors"))


def first_attribute(spark, sf_dir):
    return I.product_index(A.products(spark, sf_dir)).select("parent_asin", "first_material", "first_color")


def clean_constraint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_constraint("text").alias("cleaned"))


def constraint_origin(spark, sf_dir):
    low = F.lower("text")
    made = F.when(low.startswith("color: ") | low.startswith("budget around $") | low.isin(*V.MATERIALS), "synthesised")
    return _constraints(spark, sf_dir).select("parent_asin", "pos", made.otherwise("mined").alias("origin"))


def question_wording(spark, sf_dir):
    r = A.results(spark, sf_dir).select("sample_id", F.coalesce("first_hit_turn", F.lit(11)).alias("turn"))
    names = F.array(*map(F.lit, (*V.QUESTIONS, V.OPEN, "brand")), F.lit(None).cast("string"))
    attr = F.element_at(names, (F.pmod("sample_id", F.lit(len(V.QUESTIONS) + 3)) + 1).cast("int"))
    return r.select("sample_id", attr.alias("attribute"), T.question_text(attr, "turn").alias("question"))


def reply_wording(spark, sf_dir):
    r = A.results(spark, sf_dir).select("sample_id", F.coalesce("first_hit_turn", F.lit(11)).alias("turn"), "best_rank")
    attr = F.when(F.col("sample_id") % 3 == 0, F.lit("color")).when(F.col("sample_id") % 3 == 1, F.lit("other"))
    return r.select(
        "sample_id", T.reply_text(attr, "turn", F.coalesce("best_rank", F.lit(0)), F.col("sample_id") % 2).alias("reply")
    )


def weighted_postings(spark, sf_dir):
    return I.weighted_postings(A.products(spark, sf_dir))


def corpus_postings(spark, sf_dir):
    return I.corpus_postings(A.corpus(spark, sf_dir))


def doc_lengths(spark, sf_dir):
    p = A.products(spark, sf_dir)
    return I.doc_lengths(I.weighted_postings(p), p.select(F.col("parent_asin").alias("doc")))


def idf_table(spark, sf_dir):
    c = A.corpus(spark, sf_dir)
    post = I.corpus_postings(c)
    return I.vocabulary(post, I.corpus_stats(I.doc_lengths(post, c))).select("token", "df", F.round("idf", 6).alias("idf"))


def frequent_vocabulary(spark, sf_dir):
    c = A.corpus(spark, sf_dir)
    df = I.corpus_postings(c).groupBy("token").agg(F.count("*").alias("df"))
    return I.frequent(df, 2)


def corpus_stats(spark, sf_dir):
    c = A.corpus(spark, sf_dir)
    return I.corpus_stats(I.doc_lengths(I.corpus_postings(c), c)).select("n", F.round("avg_len", 4).alias("avg_len"))


def term_matrix(spark, sf_dir):
    """The BM25-weighted document-term matrix, one row an entry, of terms in two documents or more."""
    p = A.products(spark, sf_dir)
    post = I.weighted_postings(p)
    lengths = I.doc_lengths(post, p.select(F.col("parent_asin").alias("doc")))
    stats = I.corpus_stats(lengths)
    vocab = I.frequent(I.vocabulary(post, stats))
    rows = post.join(vocab, "token").join(lengths, "doc").crossJoin(F.broadcast(stats))
    norm = F.col("wtf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("len") / F.col("avg_len"))
    return rows.select("doc", "token", F.round(F.col("idf") * F.col("wtf") * (V.BM25_K1 + 1) / norm, 6).alias("weight"))


def category_buckets(spark, sf_dir):
    return I.category_buckets(I.product_index(A.products(spark, sf_dir)))


def bucket_lookup(spark, sf_dir):
    return I.bucket_lookup(I.product_index(A.products(spark, sf_dir)))


def popularity_prior(spark, sf_dir):
    i = I.with_popularity(I.product_index(A.products(spark, sf_dir)))
    return i.select("parent_asin", F.round("popularity", 6).alias("popularity"))


def global_popular(spark, sf_dir):
    i = popularity_prior(spark, sf_dir)
    return i.orderBy(F.desc("popularity"), "parent_asin").limit(64)


def corpus_digest(spark, sf_dir):
    h = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return _docs(spark, sf_dir).select("doc_id", F.substring(h, 1, 16).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        normalise_text, match_text_flatten, tokenize_terms, searchable_blob, coarse_category, flatten_details,
        classify_constraint, classify_kind, parse_price, attribute_hits, first_attribute, clean_constraint,
        constraint_origin, question_wording, reply_wording, weighted_postings, corpus_postings, doc_lengths, idf_table,
        frequent_vocabulary, corpus_stats, term_matrix, category_buckets, bucket_lookup, popularity_prior,
        global_popular, corpus_digest,
    )
}


def _question(attr: str, turn: str) -> str:
    opens = S.words(V.OPEN_QUESTIONS)
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.QUESTIONS.items())
    return (
        f"(CASE WHEN {attr} IS NULL THEN 'This is the nearest that the catalog has.' WHEN {attr} = 'other' THEN "
        f"{opens}[(1 + greatest({turn} - 1, 0) % {len(V.OPEN_QUESTIONS)})::INT] ELSE CASE {attr} {cases} ELSE '{V.OPEN_QUESTIONS[0]}' END END)"
    )



ORACLE_SQL = {
    "normalise_text": f"SELECT doc_id, {S.normalise('text')} AS norm FROM documents",
    "match_text_flatten": f"SELECT doc_id, {S.match_text('text')} AS flat FROM documents",
    "tokenize_terms": f"SELECT doc_id, len({S.terms('text')})::BIGINT AS n_terms, coalesce(array_to_string({S.terms('text')}, ' '), '') AS terms FROM documents",
    "searchable_blob": f"WITH {A.PRODUCTS_SQL} SELECT parent_asin, trim(array_to_string(list_filter([{', '.join(S.FIELD[n] for n in S._ORDER)}], lambda s: s <> ''), ' ')) AS searchable, {S.BLOB} AS blob FROM product",
    "coarse_category": f"WITH {A.PRODUCTS_SQL} SELECT parent_asin, array_to_string(categories, ' ') AS category, store || ' ' || title AS long_path, 'clothing item' AS root_only FROM product",
    "flatten_details": f"WITH {A.PRODUCTS_SQL} SELECT parent_asin, coalesce(array_to_string(flat, '; '), '') AS flat, len(flat)::BIGINT AS n FROM product",
    "classify_constraint": f"{_CONSTRAINTS_SQL} SELECT parent_asin, pos, text, {S.route('text')} AS attribute FROM c WHERE text IS NOT NULL",
    "classify_kind": f"{_CONSTRAINTS_SQL} SELECT parent_asin, pos, text, {S.kind('text')} AS kind, {S.kind_value('text')} AS value FROM c WHERE text IS NOT NULL",
    "parse_price": f"WITH {A.PRODUCTS_SQL}, t AS (SELECT parent_asin, unnest([price, 'from ' || price, '1,299', '$ 12.5 or 9', 'free', '0', '19.99']) AS x, unnest(range(7)) AS pos FROM product) SELECT parent_asin, pos, {S.price('x')} AS price FROM t",
    "attribute_hits": f"WITH {S.INDEX} SELECT parent_asin, coalesce(array_to_string(materials, ','), '') AS materials, coalesce(array_to_string(colors, ','), '') AS colors FROM idx",
    "first_attribute": f"WITH {S.INDEX} SELECT parent_asin, first_material, first_color FROM idx",
    "clean_constraint": "SELECT doc_id, rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' -;,.' || chr(9) || chr(10)), 1, 180)) AS cleaned FROM documents",
    "constraint_origin": f"{_CONSTRAINTS_SQL} SELECT parent_asin, pos, CASE WHEN lower(text) LIKE 'color: %' OR lower(text) LIKE 'budget around $%' OR list_contains({S.words(V.MATERIALS)}, lower(text)) THEN 'synthesised' ELSE 'mined' END AS origin FROM c WHERE text IS NOT NULL",
    "question_wording": f"WITH {A.RESULTS_SQL}, r AS (SELECT sample_id, coalesce(first_hit_turn, 11) AS turn, {S.words((*V.QUESTIONS, V.OPEN, 'brand'))}[(sample_id % {len(V.QUESTIONS) + 3})::INT + 1] AS attribute FROM result) SELECT sample_id, attribute, {_question('attribute', 'turn')} AS question FROM r",
    "reply_wording": f"WITH {A.RESULTS_SQL}, r AS (SELECT sample_id, coalesce(first_hit_turn, 11) AS turn, coalesce(best_rank, 0) AS n, CASE sample_id % 3 WHEN 0 THEN 'color' WHEN 1 THEN 'other' END AS a FROM result) SELECT sample_id, CASE WHEN n = 0 THEN 'Nothing fits so far. ' || {_question("coalesce(a, 'other')", 'turn')} WHEN a IS NULL THEN 'This is the nearest that the catalog has.' ELSE CASE WHEN sample_id % 2 > 0 THEN 'By what you told me, these fit best. ' ELSE 'For a first look, take these. ' END || {_question('a', 'turn')} END AS reply FROM r",
    "weighted_postings": f"WITH {S.POSTINGS} SELECT doc, token, wtf FROM post",
    "corpus_postings": f"WITH {S.CORPUS} SELECT doc, token, wtf FROM post",
    "doc_lengths": f"WITH {S.POSTINGS} SELECT doc, len FROM len",
    "idf_table": f"WITH {S.CORPUS} SELECT token, df, round(idf, 6) AS idf FROM voc",
    "frequent_vocabulary": f"WITH {S.CORPUS} SELECT token, df FROM voc WHERE df >= 2",
    "corpus_stats": f"WITH {S.CORPUS} SELECT n, round(avg_len, 4) AS avg_len FROM stat",
    "term_matrix": f"WITH {S.POSTINGS} SELECT doc, token, round(idf * wtf * {V.BM25_K1 + 1} / (wtf + {V.BM25_K1} * ({1 - V.BM25_B} + {V.BM25_B} * len / (SELECT avg_len FROM stat))), 6) AS weight FROM post JOIN voc USING (token) JOIN len USING (doc) WHERE df >= 2",
    "category_buckets": f"WITH {S.INDEX} SELECT category, count(*) AS size, min(parent_asin) AS first_asin FROM idx GROUP BY 1",
    "bucket_lookup": f"WITH {S.INDEX} SELECT {S.normalise('category')} AS norm_name, max(category) AS name FROM idx GROUP BY 1",
    "popularity_prior": f"WITH {S.POPULARITY} SELECT parent_asin, round(popularity, 6) AS popularity FROM pop",
    "global_popular": f"WITH {S.POPULARITY} SELECT parent_asin, round(popularity, 6) AS popularity FROM pop ORDER BY 2 DESC, 1 LIMIT 64",
    "corpus_digest": "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS digest FROM documents",
}
