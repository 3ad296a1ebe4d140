"""Operators on hand-made rows."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from parlance import config as C
from parlance.functions import text as T
from parlance.functions import vocabulary as V
from parlance.operators import dialogue as D
from parlance.operators import index as I
from parlance.operators import metrics as M
from parlance.operators import policy as P
from parlance.operators import rank as R
from parlance.operators import simulate as SIM
from parlance.operators import state as ST
from parlance.operators import stats as S
from parlance.sources import files

PRODUCTS = [
    ("A1", "Red covered shirt", ["cotton blend", "wide fit"], [], "$1,299.00", ["Clothing", "Shirts, Casual"], {"Department": "Womens"}, 4.5, 1200, "Acme"),
    ("A2", "Grey wool coat", ["wool and cotton"], ["warm"], None, ["Coats"], {}, 4.0, 12, "Acme"),
    ("A3", "snake_red belt", [], [], "25", ["Coats"], {"Color": "Blue"}, None, None, None),
    ("A4", "", None, None, "free", [], None, 3.0, 5, "Z"),
]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(PRODUCTS, files.PRODUCT)


def one(df):
    return df.collect()[0]


def test_every_pair_of_words_is_routed_in_order(spark):
    words = [w for _, group in V.ROUTES for w in group] + ["budget", "under 5", "other"]
    pairs = [(f"{a} {b}",) for a, b in itertools.product(words, words)]
    rows = spark.createDataFrame(pairs, "text string").select("text", T.classify_constraint("text").alias("a")).collect()
    for r in rows:
        want = "feature"
        if "budget" in r.text or "under 5" in r.text:
            want = "budget"
        else:
            want = next((n for n, g in V.ROUTES if any(w in r.text for w in g)), "feature")
        assert r.a == want, r.text


def test_attributes_of_products(products):
    rows = {r.parent_asin: r for r in I.product_index(products).collect()}
    assert rows["A1"].category == "Shirts Casual" and rows["A4"].category == V.NO_CATEGORY
    assert rows["A1"].price == 1.0 and rows["A2"].price is None and rows["A4"].price is None and rows["A3"].price == 25.0
    assert rows["A2"].first_color == "gray" and rows["A2"].materials == ["cotton", "wool"] and rows["A2"].first_material == "wool"
    assert rows["A3"].first_color == "red"  # the blob splits words at an underscore
    assert rows["A1"].colors == ["red"]  # not the red in covered


def test_cards_take_colours_from_raw_words(products):
    rows = {r.parent_asin: r for r in SIM.intent_card(products).collect()}
    assert rows["A1"].hard == ["cotton", "color: red"]
    assert rows["A3"].hard[0] == "Color: Blue"  # an underscore joins words, so blue comes before any red
    assert rows["A4"].hard == ["budget around $free"]


def test_satisfaction(products, spark):
    i = I.product_index(products).where("parent_asin = 'A2'")
    texts = ["wool", "cotton", "color: grey", "budget around $20", "wool coat warm", "GREY wool"]
    rows = i.withColumn("c", F.explode(R.typed(F.array(*map(F.lit, texts))))).select("c.text", R.satisfaction(F.col("c")).alias("s"))
    got = {r.text: round(r.s, 4) for r in rows.collect()}
    assert got == {"wool": 1.0, "cotton": 0.6, "color: grey": 1.0, "budget around $20": 0.25, "wool coat warm": 0.7, "GREY wool": 1.0}


def test_replies_in_order_of_their_tests(spark):
    said = {
        "For that, what matters is: red; wide fit.": ("disclosure", None, ["red", "wide fit"]),
        "I don't have an additional preference for use_case.": ("no_additional", "use_case", []),
        "I don't have a preference for other; please use your judgment.": ("boundary", "other", []),
        "Those options are not quite right yet. Ask me about one specific attribute.": ("ask_more", None, []),
        "Actually, ignore my earlier preference. What I need is: wool.": ("override", None, ["wool"]),
        "scratch that, what I need is silk, really": ("override", None, ["silk, really"]),
        "up to you on color": ("boundary", "color", []),
        "no strong view": ("no_additional", None, []),
        "hmm: leather straps": ("disclosure", None, ["leather straps"]),
        "um well ok": ("unknown", None, []),
        "": ("unknown", None, []),
        "?" * 5000: ("unknown", None, []),
        ";;; ; ;": ("unknown", None, []),
    }
    rows = spark.createDataFrame([(m,) for m in said], "m string").select("m", D.parse_reply("m").alias("r")).collect()
    for r in rows:
        assert (r.r.kind, r.r.attribute, r.r.constraints) == said[r.m], r.m


def test_openings_and_state(spark):
    lookup = spark.createDataFrame([("rain coats", "Rain Coats"), ("coats", "Coats")], "norm_name string, name string")
    rows = [
        (1, 1, "I'm looking for Rain Coats. A key requirement is: wool."), (1, 2, "Actually, ignore my earlier preference. What I need is: silk."),
        (1, 3, "I don't have an additional preference for color."), (2, 1, "hello there"), (2, 2, "some coats with wool; Wool"),
    ]
    m = spark.createDataFrame(rows, "session_id int, turn int, message string")
    found = ST.state(m, lookup)
    turns = {(r.session_id, r.turn): r for r in found["turns"].collect()}
    assert turns[(1, 3)].category == "Rain Coats" and turns[(1, 3)].exhausted == ["color"]
    assert turns[(2, 1)].category is None and turns[(2, 2)].category == "Coats"
    known = {(r.session_id, r.turn, r.text): r.weight for r in found["constraints"].collect()}
    assert known[(1, 1, "wool")] == 1.0 and known[(1, 2, "wool")] == 0.5 and known[(1, 3, "silk")] == 1.0
    erased = ST.state(m, lookup, C.Config(override_decay=0.0))
    terms = {(r.session_id, r.token): r.boost for r in ST.query_terms(erased, C.Config(override_decay=0.0)).collect()}
    assert terms[(1, "wool")] == -0.35 and terms[(1, "coats")] == 1.0 and terms[(1, "silk")] == 2.2


def test_price_partition_needs_four_prices(spark):
    rows = [("a", str(i), float(i) if i < 3 else None) for i in range(6)] + [("b", str(i), float(i)) for i in range(8)]
    pool = spark.createDataFrame(rows, "query string, parent_asin string, price double")
    got = {r.query: r.power for r in P.price_partition(pool).collect()}
    counts = [3, 2, 2, 1]  # cut at the third, fifth and seventh of eight prices
    import math

    want = -sum(c / 8 * math.log2(c / 8) for c in counts) / 2
    assert got["a"] == 0.0 and got["b"] == pytest.approx(want)


def test_known_metrics(spark):
    schema = "sample_id string, scenario_type string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double"
    rows = spark.createDataFrame([("a", "x", True, 2, 2, 0.5), ("b", "x", False, None, None, 0.0)], schema)
    m = one(M.session_metrics(rows))
    assert (m.hit_rate, m.mrr, m.mttc) == (0.5, 0.25, 6.5)
    empty = one(M.session_metrics(rows.limit(0)))
    assert (empty.sample_count, empty.hit_rate, empty.mrr, empty.mttc) == (0, 0.0, 0.0, None)
    miss = [r for r in M.by_scenario(rows.where("NOT hit")).collect() if r.scenario_type == "ALL"][0]
    assert (miss.mttc, miss.composite) == (11.0, 0.0)


def test_permutations_are_whole(spark):
    orders = [[2, 2, -1, 9, 0], [], [None, 1], [5, 4, 3, 2, 1, 0]]
    rows = spark.createDataFrame([(o, 4) for o in orders], "o array<int>, n int").select(R.permuted(F.col("o"), F.col("n")).alias("p"))
    assert [r.p for r in rows.collect()] == [[2, 0, 1, 3], [0, 1, 2, 3], [1, 0, 2, 3], [3, 2, 1, 0]]


def test_apportionment_is_exact(spark):
    totals = [10, 100, 110, 137, 1000]
    rows = S.apportion(spark.createDataFrame([(t,) for t in totals], "total bigint")).collect()
    for t in totals:
        counts = {r.scenario: r["count"] for r in rows if r.total == t}
        assert sum(counts.values()) == t
        assert all(abs(counts[n] - t * s) < 1 for n, s in V.SCENARIO_MIX)


def test_numbering_spans_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = S.numbered(df, "k").orderBy("i").collect()
    assert [(r.k, r.i) for r in rows] == [(i, i) for i in range(1000)]


def test_matched_sample_uses_each_product_once(spark):
    pool = spark.createDataFrame([(f"p{i}", i) for i in range(20)], "parent_asin string, rating_number bigint")
    goal = spark.createDataFrame([(5,), (6,)], "rating_number bigint")
    got = [r.parent_asin for r in S.sample_matched(pool, goal, 6).orderBy("place").collect()]
    assert len(set(got)) == 6 and {int(g[1:]) for g in got} <= set(range(1, 11))
    assert S.sample_matched(pool.limit(0), goal, 6).count() == 0


def test_configuration(monkeypatch):
    with pytest.raises(ValueError, match="clarify_strategy"):
        C.Config(clarify_strategy="guess")
    monkeypatch.setenv("PARLANCE_CONFIG", json.dumps({"w_bm25": 2.0, "unknown": 1}))
    assert C.from_environment().w_bm25 == 2.0
    monkeypatch.setenv("PARLANCE_CONFIG", "{")
    assert C.from_environment() == C.Config()


def test_catalog_files_and_stored_index(spark, tmp_path):
    path = tmp_path / "catalog.jsonl"
    lines = [{"parent_asin": "A", "title": "old"}, {"parent_asin": "B", "price": 5}, {"parent_asin": "A", "title": "new", "details": {"k": "v"}}]
    path.write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    rows = {r.parent_asin: r for r in files.read_catalog(spark, str(path)).collect()}
    assert rows["A"].title == "new" and rows["B"].price == "5" and len(rows) == 2
    digest = files.content_digest(spark, str(path))
    assert len(digest) == 16
    built = []

    def build():
        built.append(1)
        return files.read_catalog(spark, str(path))

    for _ in range(2):
        assert files.stored(spark, str(tmp_path / "index"), digest, "products", build).count() == 2
    assert built == [1]
    vectors = spark.createDataFrame([("a", [1.0, 1e9])], "doc string, v array<double>")
    files.write_vectors(vectors, str(tmp_path / "v"), "test", digest)
    assert files.read_vectors(spark, str(tmp_path / "v"), digest).first().v == [1.0, 65000.0]
    assert files.read_vectors(spark, str(tmp_path / "v"), "other") is None


def test_diversified_list_prefers_other_titles(spark):
    rows = [("q", "a", 1.0, ["red", "coat"]), ("q", "b", 0.99, ["red", "coat"]), ("q", "c", 0.9, ["hat"])]
    df = spark.createDataFrame(rows, "query string, doc string, score double, title_tokens array<string>")
    assert [r.doc for r in R.mmr(df, 3, 0.5).orderBy("rank").collect()] == ["a", "c", "b"]


def test_simulated_sessions_are_kept_whole(spark, small):
    from parlance.config import Config
    from parlance.operators import evaluate as E
    from parlance.plans import evaluation, ranking

    base = evaluation._base(spark, small)
    sessions = ranking._sessions(spark, small).where("query IN ('S1','S2','S4','S7','S11','S13')")
    out = E.simulate(sessions, base, Config(min_candidates=1)).collect()
    assert len(out) == sessions.count() == len({r.sample_id for r in out})
    assert all((r.first_hit_turn is not None) == r.hit and (not r.hit or 1 <= r.best_rank <= 10) for r in out)


def test_a_stored_table_that_cannot_be_opened_is_built_anew(spark, tmp_path):
    from parlance.sources import files

    made = lambda: spark.range(3)
    files.stored(spark, str(tmp_path), "d", "t", made)
    for f in (tmp_path / f"v={files.INDEX_VERSION}" / "digest=d" / "t").glob("*.parquet"):
        f.write_bytes(b"broken")
    assert files.stored(spark, str(tmp_path), "d", "t", made).count() == 3


def test_latent_keeps_every_term(spark, monkeypatch):
    from parlance.operators import dense

    rows = [(f"d{i % 20}", f"t{i:05}", 1.0 + i % 7) for i in range(20_005)] + [("last", "zz", 500.0)]
    matrix = spark.createDataFrame(rows, "doc string, token string, weight double")
    docs, terms = dense.latent(matrix, 3)
    assert terms.count() == 20_006 and "last" in {r.doc for r in docs.collect()}
    monkeypatch.setattr(dense, "MOST_TERMS", 100)
    with pytest.raises(ValueError, match="100 distinct terms"):
        dense.latent(matrix, 3)


def _state(rows):
    return sorted((r.session_id, r.turn, r.kind, r.category, r.constraints, r.exhausted) for r in rows)


def test_the_stream_gives_the_states_of_the_batch_in_any_order_of_files(spark, small, tmp_path):
    """Turns of one session lie in different files, later ones in earlier files."""
    from pyspark.sql import functions as F

    from parlance.operators import state as ST
    from parlance.plans import conversation
    from parlance.sources import adapters as A
    from parlance.streaming import sessions

    messages = A.messages(spark, small).where("session_id < 40")
    lookup = conversation._lookup(spark, small)
    got = sessions.replay(messages, lookup, str(tmp_path / "replay"), files=3)
    found = ST.state(messages, lookup)
    said = found["constraints"].groupBy("session_id", "turn").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("added", "pos", "text"))), lambda c: c["text"]), " | ").alias("constraints")
    )
    want = found["turns"].join(found["acts"].select("session_id", "turn", "kind"), ["session_id", "turn"]).join(said, ["session_id", "turn"], "left")
    want = want.select("session_id", "turn", "kind", "category", F.coalesce("constraints", F.lit("")).alias("constraints"), F.array_join("exhausted", ",").alias("exhausted"))
    assert _state(got.collect()) == _state(want.collect()) and got.count() > 20


def test_late_turns_are_put_in_their_places():
    from parlance.streaming import sessions

    acts = [(1, "opening", None, None, ["Red  shoes"]), (2, "disclosure", "Shoes", None, ["red shoes", "wide"]), (3, "no_additional", "Other", None, [])]
    assert sessions.states(acts) == [(None, "Red  shoes", ""), ("Shoes", "Red  shoes | wide", ""), ("Shoes", "Red  shoes | wide", "other")]


def test_containment_equals_brute_force(spark):
    import random

    from parlance.operators import lexical as L

    rng = random.Random(3)
    words = ["red", "covered", "shoe", "shoes", "a", "wide", "fit", "xl", "readable"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    needles = {" ".join(rng.choice(words) for _ in range(n))[rng.randint(0, 2) :].strip() for n in (1, 1, 2, 2, 3, 4, 5) for _ in range(25)} - {""}
    needles = {" ".join(n.split()) for n in needles}
    found = L.containing(
        spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    )
    assert sorted((r.needle, r.doc) for r in found.collect()) == sorted((n, i) for n in needles for i, t in enumerate(texts) if n in t)


def test_matched_sample_equals_the_walk_by_hand(spark):
    from parlance.operators import stats as ST

    pool = spark.createDataFrame([(f"P{i:03d}", i * i % 97) for i in range(120)], "parent_asin string, rating_number bigint")
    reference = spark.createDataFrame([(v,) for v in (3, 50, 50, 96, 200)], "rating_number bigint")
    rows = sorted((r.rating_number, r.parent_asin) for r in pool.collect())
    import hashlib

    goals, free, want = [3, 50, 50, 96, 200], set(range(120)), []
    for place in range(40):
        goal = goals[int(hashlib.md5(f"4|{place}".encode()).hexdigest()[:12], 16) % 5]
        start = sum(n < goal for n, _ in rows)
        hit = min(free, key=lambda i: (abs(i - start), i < start))
        free.remove(hit)
        want.append((place, rows[hit][1]))
    assert sorted((r.place, r.parent_asin) for r in ST.sample_matched(pool, reference, 40).collect()) == want
    assert ST.sample_matched(pool.limit(0), reference, 5).count() == 0 and ST.sample_matched(pool.limit(3), reference, 5).count() == 3


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_products_are_dealt_out_by_key(spark, small, monkeypatch):
    from parlance.plans import catalog
    from parlance.sources import adapters as A

    monkeypatch.setattr(A, "PRODUCTS", 15)
    p = A.products(spark, small)
    sizes = [r["count"] for r in p.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 45 and sum(sizes) == A.table(spark, small, "part").count()
    assert "hashpartitioning(doc" not in _plan(catalog.weighted_postings(spark, small))  # counted where the products lie


def test_passages_are_scored_where_documents_lie(spark, small):
    from parlance.plans import ranking

    plan = _plan(ranking.bm25_topk(spark, small))
    assert "hashpartitioning(doc" in plan and "hashpartitioning(query#" in plan
    assert not any("hashpartitioning(" in line and "token#" in line and "doc#" in line for line in plan.splitlines())


def test_no_needle_meets_all_words(spark):
    from parlance.operators import lexical as L

    texts = spark.createDataFrame([(1, "a wool: coat"), (2, "woollen coats")], "doc int, text string")
    needles = spark.createDataFrame([("l: c",), ("en co",), ("oo",), ("absent",)], "needle string")
    found = L.containing(needles, texts)
    assert sorted(map(tuple, found.collect())) == [("en co", 2), ("l: c", 1), ("oo", 1), ("oo", 2)]
    assert "NestedLoop" not in _plan(found) and "Cartesian" not in _plan(found)


def _pools(spark, small):
    from parlance.plans import ranking

    sessions, index = ranking._sessions(spark, small), ranking._indexed(spark, small)
    rows = sessions.select("query", "category", "target", "preference_tags", R.typed(F.col("texts")).alias("constraints")).join(index, "category")
    return sessions, index.withColumn("lexical", F.lit(0.5)), rows.withColumn("lexical", F.lit(0.5))


@pytest.mark.parametrize("products, states", [(16_384, 8_192), (2, 1)])
def test_blocks_score_as_the_rows_do(spark, small, monkeypatch, products, states):
    """Also when a category is cut into several blocks both ways."""
    from parlance.operators import lexical as L
    from parlance.operators import pools as PL

    monkeypatch.setattr(PL, "PRODUCTS", products)
    monkeypatch.setattr(PL, "STATES", states)
    sessions, index, rows = _pools(spark, small)
    got = L.top_k(PL.top(PL.products(index, lexical=F.col("lexical")), PL.states(sessions, F.col("query")), 3), 3)
    pick = lambda df: sorted((r.query, r["rank"], r.doc, r.score) for r in df.collect())
    assert pick(got) == pick(R.ranked(rows, 3))
    met = PL.every(PL.products(index), PL.states(sessions, F.col("query")), "met")
    want = rows.select("query", "parent_asin", F.round(R.constraint_score(F.col("constraints")), 6).alias("met"))
    assert sorted((r.query, r.doc, round(r.met, 6)) for r in met.collect()) == sorted(map(tuple, want.collect()))


def test_places_of_targets_in_blocks(spark, small, monkeypatch):
    from parlance.operators import pools as PL

    monkeypatch.setattr(PL, "PRODUCTS", 2)
    sessions, index, rows = _pools(spark, small)
    scored = rows.select("query", F.col("parent_asin").alias("doc"), "target", F.round(R.blend(), 6).alias("score"))
    pool = PL.products(index, lexical=F.col("lexical"))
    own = sessions.join(PL.own(pool, PL.states(sessions, F.struct("query", "target"))), "query")
    got = PL.standing(pool, PL.states(own, F.struct("query", "target", "own", "goal"))).collect()
    want = {r.query: (r.pool_size, r.strictly_above, r.tied) for r in S.rank_diagnosis(scored).collect()}
    assert {r.query: (r["size"], r.above, r.tied - 1) for r in got} == want


def test_without_constraints_tags_count(spark, small):
    """Texts that many sessions share are one state; a state without constraints keeps its tags."""
    from parlance.operators import lexical as L
    from parlance.operators import pools as PL

    sessions, index, rows = _pools(spark, small)
    cold = sessions.withColumn("texts", F.array().cast("array<string>"))
    assert PL.states(cold, F.col("query")).count() < sessions.count()
    rows = rows.withColumn("constraints", F.filter("constraints", lambda c: F.lit(False)))
    got = L.top_k(PL.top(PL.products(index, lexical=F.col("lexical")), PL.states(cold, F.col("query")), 3), 3)
    pick = lambda df: sorted((r.query, r["rank"], r.doc, r.score) for r in df.collect())
    assert pick(got) == pick(R.ranked(rows, 3))


def test_simulation_in_many_blocks_leaves_no_turns_behind(spark, small, monkeypatch):
    from pathlib import Path

    from parlance.config import Config
    from parlance.operators import evaluate as E
    from parlance.operators import pools as PL
    from parlance.plans import evaluation, ranking
    from parlance.sources.shared import shared_dir

    base = evaluation._base(spark, small)
    sessions = ranking._sessions(spark, small).where("query IN ('S1','S2','S4','S7','S11','S13')")
    run = lambda: sorted(map(str, E.simulate(sessions, base, Config(min_candidates=1)).collect()))
    want, folder = run(), Path(shared_dir(spark).removeprefix("file:"))
    before = len(list(folder.glob("rows-*")))
    monkeypatch.setattr(PL, "PRODUCTS", 1)
    assert run() == want
    assert len(list(folder.glob("rows-*"))) - before <= E.MAX_TURNS  # the sessions that ended in each turn


def test_cosines_of_blocks_equal_those_of_pairs(spark, monkeypatch):
    import random

    from parlance.operators import dense as DN

    rng = random.Random(5)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [1.0]), (62, [0.5, None, 0.5]), (63, [float("nan"), 0.0, 0.0])]
    docs = spark.createDataFrame(rows, "doc bigint, v array<float>")
    asked = docs.where("doc % 7 = 4").select(F.col("doc").alias("query"), F.col("v").alias("q"))
    pairs = docs.join(asked, F.col("doc") != F.col("query")).select("query", "doc", F.round(DN.dot(F.col("q"), F.col("v")), 5).alias("cosine"))
    order = DN.Window.partitionBy("query").orderBy(F.desc("cosine"), "doc")
    pick = lambda df: sorted((r.query, r["rank"], r.doc, str(r.cosine)) for r in df.collect())
    want = pick(pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 10"))
    monkeypatch.setattr(DN, "DOCS", 16)
    monkeypatch.setattr(DN, "QUERIES", 3)
    assert pick(DN.cosine_topk(asked, docs)) == want


def test_no_table_of_messages_is_broadcast(spark, small):
    from parlance.plans import conversation
    from parlance.sources import adapters as A
    from parlance.sources.shared import broadcast_if_few

    acts = ST.parsed(A.messages(spark, small), broadcast_if_few(conversation._lookup(spark, small)))
    assert "BroadcastHashJoin [norm_name" in _plan(acts)
    assert not any("BroadcastHashJoin" in line and "norm_name" not in line for line in _plan(acts).splitlines())


def test_a_draw_travels_as_one_number(spark):
    rows = spark.range(50).select(F.col("id").alias("i"), (F.col("id") * 2).alias("delta"))
    got = sorted((r["round"], r.i) for r in S._drawn(rows, 7, 2).collect())
    assert got == sorted((r["round"], r.i) for r in S.resamples(spark, 50, 7, 2).collect())
    assert all(r.delta == 2 * r.i for r in S._drawn(rows, 7, 2).collect())
