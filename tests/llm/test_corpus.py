"""Operators across rows against brute force, and the pipeline."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import mixing, neighbours, simhash
from parlance.llm.components import connected_components


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 120))) for _ in range(n // 3)]
    out = list(texts)
    while len(out) < n:
        t = rng.choice(texts).split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return [*out, "", "  \t", "one", "ONE", "one two", "É a b c", "x " * 5000]


def test_fingerprints():
    for t in corpus():
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_simhash_equals_brute_force(spark):
    texts = corpus()
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (990, None), rows[0], (None, texts[1])], "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    got = simhash.query(docs).collect()
    assert len(got) == len(texts) + 3
    fp = {i: brute_fingerprint(t) for i, t in rows} | {990: 0}
    want = brute_components(fp, [(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3])
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", want[r.doc_id])
        else:
            assert r.component_id == want[rows[1][0]]
    assert simhash.query(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [7, 1000])
def test_links_in_shards_connect_the_same(spark, shard_rows):
    rng = random.Random(2)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(6):  # chains of near values
            values.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for blocks in (4, 6):
        old = simhash.blocks_for
        simhash.blocks_for = lambda *_, b=blocks: b
        try:
            found = [(r.a, r.b) for r in simhash.links(df, 3, shard_rows).collect()]
        finally:
            simhash.blocks_for = old
        mask = (1 << 64) - 1
        near = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & mask).bit_count() <= 3]
        assert brute_components(signed, found) == brute_components(signed, near)


def test_block_count_follows_the_input():
    assert simhash.blocks_for(1000, 3) == 4
    assert simhash.blocks_for(10**9, 3) > 4
    keys = simhash.keys_for(0.8)
    assert 1 - (1 - 0.8**simhash.KEY_VALUES) ** keys >= simhash.KEY_RECALL


def test_near_copies_by_similarity(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(2000)]
    rows, group = [], {}
    for g in range(40):
        base = [rng.choice(words) for _ in range(400)]
        for c in range(3):
            t = list(base)
            for _ in range(4 * c):  # four changed words in 400 cost about 10 % of the shingles
                t[rng.randrange(400)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(t), "en"))
    docs = spark.createDataFrame([*rows, rows[0], (None, None, "en"), (500, "", "de")], "doc_id bigint, text string, lang string")
    kept = simhash.deduplicated(docs).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None and r.doc_id < 120)
    assert len(ids) == len(set(ids)) and {group[i] for i in ids} == set(range(40))
    assert len(ids) <= 44  # of 80 near copies, at most four were missed
    assert sum(r.text in (None, "") for r in kept) == 1
    assert set(kept[0].asDict()) == {"doc_id", "text", "lang"}


def brute_jaccard(a, b, width=5):
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def around_the_limit():
    """(texts, pairs): 500 pairs just above a similarity of 0.8, 500 from 0.70 to just below it, and short texts."""
    rng = random.Random(6)
    texts, pairs = [], []
    for n in range(1000):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice((60, 200, 400)))]
        low, high = (0.8, 0.815) if n % 2 else (0.70, 0.7999)
        while True:  # the end is replaced, so one word costs one shingle
            k = rng.randrange(len(base) // 3)
            other = base[: len(base) - k] + [f"u{rng.randrange(10**6)}" for _ in range(k)]
            if low <= brute_jaccard(" ".join(base), " ".join(other)) <= high:
                break
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(other)]
    nine = [f"s{i}" for i in range(9)]  # five shingles against four: 0.8 exactly
    pairs.append((len(texts), len(texts) + 1))
    texts += [" ".join(nine), " ".join(nine[:-1])]
    return texts, pairs


@pytest.mark.parametrize("shard", [None, 1000])
def test_near_copies_at_the_limit(spark, monkeypatch, shard):
    texts, pairs = around_the_limit()
    if shard:
        exact = simhash.confirmed_links
        monkeypatch.setattr(simhash, "confirmed_links", lambda *a: exact(*a, shard_shingles=shard))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    part = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    above = [(a, b) for a, b in pairs if brute_jaccard(texts[a], texts[b]) >= 0.8]
    below = [(a, b) for a, b in pairs if brute_jaccard(texts[a], texts[b]) < 0.8]
    assert len(above) == 501 and len(below) == 500
    recall = sum(part[a] == part[b] for a, b in above) / len(above)
    false = sum(part[a] == part[b] for a, b in below)
    print(f"recall {recall:.4f}, false links {false} of {len(below)}")
    assert recall >= 0.99 and false == 0


@pytest.mark.parametrize("shard_rows", [6, simhash.SHARD_ROWS])
def test_near_copies_are_found_by_trees_of_simhashes(spark, monkeypatch, shard_rows):
    texts, pairs = around_the_limit()
    sets = [simhash.shingle_set(t) for t in texts]
    wide = [simhash.wide_fingerprint(s) for s in sets]
    name = [int(x) for x in np.frombuffer(b"".join(w[:8] for w in wide), np.int64)]
    df = spark.createDataFrame([(bytearray(w), len(s)) for w, s in zip(wide, sets)], "wide binary, n bigint")
    found = {(r.a, r.b) for r in simhash.similar_links(df, 0.8, shard_rows).collect()}
    part = brute_components(name, found)
    radius = simhash.radius_for(simhash.differing_shares(0.8).max())
    bits = np.unpackbits(np.frombuffer(b"".join(w[:16] for w in wide), np.uint8).reshape(-1, 16), axis=1).astype(np.int32)
    apart = bits.sum(1)[:, None] + bits.sum(1) - 2 * bits @ bits.T
    within = brute_components(name, [(name[a], name[b]) for a, b in np.argwhere(apart <= radius).tolist()])
    assert all(within[a] == within[b] for a, b in found)
    above = [(a, b) for a, b in pairs if brute_jaccard(texts[a], texts[b]) >= 0.8]
    assert sum(part[name[a]] == part[name[b]] for a, b in above) >= 0.99 * len(above)
    # Nothing beside the trees finds a near copy.
    monkeypatch.setattr(simhash, "similar_links", lambda distinct, similarity: spark.createDataFrame([], "a bigint, b bigint"))
    docs = spark.createDataFrame(list(enumerate(texts[:8])) + [(8, texts[0])], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect()) == [*((i, i) for i in range(8)), (8, 0)]


@pytest.mark.parametrize("shard_rows", [50, simhash.SHARD_ROWS])
def test_links_of_near_copies_do_not_grow_with_the_keys(spark, monkeypatch, shard_rows):
    """One group of 300 near copies, and pairs at the limit, which the first keys mostly miss."""
    rng, (texts, _) = random.Random(8), around_the_limit()
    base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    sets = [simhash.shingle_set(t) for t in texts[:400]]
    for _ in range(300):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(300)] = f"u{rng.randrange(10**6)}"
        sets.append(simhash.shingle_set(" ".join(t)))
    wide = [simhash.wide_fingerprint(s) for s in sets]
    name = [int(x) for x in np.frombuffer(b"".join(w[:8] for w in wide), np.int64)]
    df = spark.createDataFrame([(bytearray(w), len(s)) for w, s in zip(wide, sets)], "wide binary, n bigint").repartition(4)
    asked, real = [], connected_components

    def counted(links):
        asked.append(links.distinct().count())
        return real(links)

    monkeypatch.setattr(simhash, "connected_components", counted)
    found = {(r.a, r.b) for r in simhash.similar_links(df, 0.8, shard_rows).collect() if r.a != r.b}
    few = {(a, b) for a, b in found if {a, b} & set(name[400:])}
    print(f"links {len(found)}, of the group {len(few)}, of the first keys {asked}")
    assert 299 <= len(few) <= 2 * 300
    monkeypatch.setattr(simhash, "FIRST_KEYS", 10**6)  # all keys at once
    alone = {(r.a, r.b) for r in simhash.similar_links(df, 0.8, shard_rows).collect()}
    assert len({(a, b) for a, b in alone if {a, b} & set(name[400:])}) > 4 * 300
    part = brute_components(name, found)
    assert part == brute_components(name, alone)
    assert len({part[x] for x in name[400:]}) == 1 and len({part[x] for x in name[:400]}) < 300
    assert asked and asked[0] <= 4 * len(name)


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 300, 511):
        sets, ones = rng.integers(0, 1 << 63, n, np.uint64), np.zeros(simhash.WIDE_BITS, int)
        for s in sets:  # the fingerprint of one shingle is its own bits
            ones += np.unpackbits(np.frombuffer(simhash.wide_fingerprint(np.array([s])), np.uint8))
        assert simhash.wide_fingerprint(sets) == np.packbits(2 * ones > n).tobytes()


def test_confirmed_links_equal_brute_force():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    texts = set()
    for _ in range(250):  # chains of texts that drift away from each other
        t = rng.choice(base)
        t[rng.randrange(len(t))] = rng.choice(words)
        texts.add(" ".join(t))
    texts = sorted(texts)
    sets = simhash.Confirmed(0.8)
    for i, t in enumerate(texts):
        sets.add(i, simhash.shingle_set(t))
    linked = [(a, b) for a, b in combinations(range(len(texts)), 2) if brute_jaccard(texts[a], texts[b]) >= 0.8]
    assert linked
    assert {i: sets.find(i) for i in range(len(texts))} == brute_components(range(len(texts)), linked)


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
    rows = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    got = {r.node: r.root for r in rows}
    assert len(got) == len(rows) == 201 + 100 + 3
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1100)} == {1000} and got[5002] == 5000
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (20, 16))
    v = (centres[rng.integers(0, 20, 1200)] + rng.normal(0, 1, (1200, 16))).astype(np.float32)
    v[700] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(1200)]
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [float("inf")] + [1.0] * 15), (None, rows[0][1]), rows[3]]
    table = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<float>").withColumn("label", F.lit(1)).withColumn("score", F.lit("clash"))
    got = {}
    for r in neighbours.query(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 100))
    found = total = 0
    for q, near in got.items():
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1200), d))[:10]
        assert all(abs(d[i] - s) < 1e-12 for i, s in near) and near == sorted(near, key=lambda x: (x[1], x[0]))
        found += len({i for i, _ in near} & set(want.tolist()))
        total += 10
    assert found / total >= 0.95
    assert got[100][0] == (700, 0.0)
    few = neighbours.query(table.where("vec_id IN (0, 1, 2)")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert neighbours.query(table.limit(0)).count() == 0


def brute_neighbours(rows, q_id, q, k=10):
    """(distance, id) of the k nearest rows (id, vector) with another id and as many components."""
    found = {}
    for i, v in rows:
        if i is not None and i != q_id and len(v) == len(q):
            d = float(np.sqrt(((np.asarray(v, float) - np.asarray(q, float)) ** 2).sum()))
            found[i] = min(d, found.get(i, np.inf))
    return sorted((d, i) for i, d in found.items())[:k]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_in_many_cells_with_copies_and_other_lengths(spark, kind):
    """Clusters in 32 cells: far cells are not asked. One vector has 400 copies; some vectors are shorter."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 6, (25, 24))
    v = centres[rng.integers(0, 25, 1500)] + rng.normal(0, 0.4, (1500, 24))
    rows = [(i, v[i].astype(np.float32).astype(float).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[100][1]) for i in range(400)]
    rows += [(3000 + i, rng.normal(0, 1, 6).astype(np.float32).astype(float).tolist()) for i in range(30)]
    rows += [(4000, rows[7][1]), (4000, rows[8][1])]  # one id with two vectors
    table = spark.createDataFrame([*rows, rows[100]], f"vec_id bigint, embedding array<{kind}>").repartition(4)
    got = {}
    for r in neighbours.nearest(table, shard_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    asked = {i: q for i, q in rows if i % 100 == 0 and i != 4000}
    assert set(got) == {*asked, 4000}
    found = 0
    for i, q in asked.items():
        want = brute_neighbours(rows, i, q)
        assert [x for _, x in got[i]] == [x for _, x in sorted(got[i])]
        found += len({x for _, x in want} & {x for _, x in got[i]}) / len(want)
    assert found / len(asked) >= 0.95
    assert [x for _, x in got[100]] == list(range(2000, 2010)) and [x for _, x in got[2000]] == [100, *range(2001, 2010)]
    assert all(x >= 3000 for _, x in got[3000]) and len(got[3000]) == 10


def test_the_chi_square_stop_fires():
    """Near uniform vectors: less than half of the rows are verified, and recall stays."""
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (8000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    shard, hit = neighbours.Shard(v, [[i] for i in range(len(v))], 24, 0.08, 11), 0
    for i in range(0, 8000, 200):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        near = shard.search(i, v[i], 10, float("inf"))
        assert all(abs(d[x] - s) < 1e-12 for s, x in near)
        hit += len(set(np.argsort(d)[:10].tolist()) & {x for _, x in near})
    share = shard.verified / 40 / len(v)
    print(f"recall {hit / 400:.3f}, verified {share:.3f}")
    assert hit / 400 >= 0.9 and share < 0.5


def test_cells_and_boxes_agree():
    rng = np.random.default_rng(7)
    points = rng.normal(0, 1, (5000, 6))
    cells = neighbours.Cells(points[:500], 5)
    own = cells.of(points)
    assert set(own.tolist()) == set(range(32))
    assert ((points >= cells.low[own]) & (points <= cells.high[own])).all()
    limit = np.full(40, 0.5)
    i, c = cells.near(points[:40], limit)
    want = {(a, int(own[b])) for a in range(40) for b in range(5000) if ((points[a] - points[b]) ** 2).sum() <= 0.5}
    assert want <= set(zip(i.tolist(), c.tolist())) and len(i) < 40 * 32


DOCS = [(i, "a b c " * (i % 7 + 1), ("en", "de", None)[i % 3 if i % 5 else 0], f"s{i % 4 if i % 3 else 0}") for i in range(300)]


def test_raked_shares_meet_their_targets(spark):
    docs = spark.createDataFrame([*DOCS, (None, None, None, None)], "doc_id bigint, text string, lang string, source string").withColumn("topic", F.lit("clash"))
    targets = mixing.Targets(shares={"source": {"s0": 0.25, "s1": 0.25}}, rounds=50)
    rows = mixing.mix(docs, targets).collect()
    assert len(rows) == 301
    total = sum(r.n_tokens * r.weight for r in rows)
    share = sum(r.n_tokens * r.weight for r in rows if r.source == "s0") / total
    assert share == pytest.approx(0.25, abs=1e-3)
    assert max(r.probability for r in rows) == 1.0 and all(r.sampled for r in rows if r.probability == 1.0)
    few = mixing.Targets(shares=targets.shares, rounds=2)
    table = {r.doc_id: r.weight for r in mixing.mix(docs, few, max_cells=0).collect()}
    for r in mixing.mix(docs, few).collect():
        assert table[r.doc_id] == pytest.approx(r.weight, abs=1e-4)
    assert mixing.mix(docs.limit(0), targets).count() == 0
    kept = mixing.sampled(docs, targets)
    assert kept.columns == docs.columns and kept.count() == sum(r.sampled for r in rows)


def test_pipeline_mixing_keeps_its_share_beside_rare_sources(spark):
    import corpus_pipeline as P

    rows = [(i, "one two three four", ("en", "en", "en", "de")[i % 4], "hot" if i % 100 else "warm") for i in range(10_000)]
    rows += [(20_000 + i, "one two three four", "fr", "rare") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = dict(P.STAGES)["mixing"](spark, docs, "").count() / len(rows)
    print(f"kept {kept:.3f}; without a least share {mixing.sampled(docs).count() / len(rows):.3f}")
    assert kept >= 0.74
    for cells in (mixing.MAX_CELLS, 0):
        r = mixing.deviation(docs, mixing.Targets(least=0.75, rounds=2), cells).first()
        assert r.kept_tokens == pytest.approx(0.75, abs=1e-3) and 0 < r.moved < 0.25
    assert mixing.deviation(docs, mixing.Targets(rounds=2)).first().moved == pytest.approx(0, abs=1e-9)


def test_scale_reaches_the_share():
    rng = np.random.default_rng(7)
    for _ in range(50):
        t, w = rng.integers(0, 1000, 30).astype(float), rng.lognormal(0, 3, 30)
        for least in (0.0, 0.3, 0.75, 1.0):
            p = np.minimum(1, mixing.scale(t, w, least) * w)
            assert (t * p).sum() >= least * t.sum() * (1 - 1e-9)
            free = (t * np.minimum(1, w / w[t > 0].max())).sum()
            assert (t * p).sum() == pytest.approx(max(free, least * t.sum()))


def test_topics_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(1, 60)]) + rng.choice(("", ".", ",")) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, " \t.,"), rows[0]]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    bags = [[w for w in (t or "").translate(str.maketrans(".,;:!?", " " * 6)).split()] for _, t in rows]
    held = {w: sum(w in b for b in bags) for w in words}
    band = sorted((w for w in words if held[w] * 200 >= len(rows) and held[w] * 20 <= len(rows)), key=lambda w: (-held[w], w))
    topics = mixing.Topics(words=10)
    assert mixing.key_words(docs, topics) == {w.encode(): held[w] for w in band[:10]} and len(band) > 10
    want = sorted(
        (i, min((w for w in b if w in band[:10]), key=lambda w: (-(b.count(w) / held[w]), w), default=mixing.NO_TOPIC)) for (i, _), b in zip(rows, bags)
    )
    assert sorted((r.doc_id, r.topic) for r in mixing.mix(docs, topics=topics).collect()) == want
    assert len({t for _, t in want}) > 5


CLASHES = (
    "_tokens", "_source", "_lang", "_topic", "_sampled", "_weight", "_probability", "_lang_cell", "row", "IDS", "N_Tokens", "decoded",
    "__near_id", "id", "no_id", "hash", "fp", "root", "salt", "spans", "score", "held_out", "text_hash", "component_id", "keep_hash", "cell", "h",
)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with names that operators use."""
    long = " ".join(f"word{i % 9000}" for i in range(60_000))
    rows = [
        (1, "a plain text of some words that is kept", "en", "s1", 39), (1, "a plain text of some words that is kept", "en", "s1", 39),
        (2, None, "en", "s1", None), (3, "", None, None, 0), (None, "no id at all but words", "de", "s2", 22), (None, None, None, None, None),
        (4, long, "en", "s1", len(long)), (5, "tie one", "en", "s2", 7), (5, "tie two", "en", "s2", 7), (6, "x" * 100_000, "fr", "s3", 100_000),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for i, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(f"own {i}"))
    return df.withColumn("nested", F.struct(F.lit(1).alias("text"))).repartition(3)


@pytest.fixture(scope="module")
def odd_labels(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(1, 1, 0), (2, None, None), (None, 0, 1), (4, 1, 0), (5, 0, 0), (5, 0, 1)]
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def _plain(rows):
    return sorted((r.asDict(recursive=True) for r in rows), key=str)


@pytest.mark.parametrize("name", ["toxicity", "near copies", "secrets", "mixing", "encoding"])
def test_every_stage_takes_odd_rows_and_empty_tables(spark, odd, odd_labels, name):
    import corpus_pipeline as P

    stage = dict(P.STAGES)[name]
    out = stage(spark, odd, odd_labels)
    got, given = out.collect(), odd.collect()
    if name != "encoding":
        assert out.columns == odd.columns
        assert all(r[f] == v for r in got for f, v in ((c, f"own {i}") for i, c in enumerate(CLASHES)))
    if name in ("toxicity", "secrets"):
        assert _plain(got) == _plain(given)  # nothing is toxic or secret
    elif name == "near copies":  # the null and empty texts are one group, repeated rows another
        assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None and r.text) == sorted({(r.doc_id, r.text) for r in given if r.doc_id is not None and r.text})
        assert [(r.doc_id, r.text) for r in got if not r.text] == [(2, None)]
        assert [r.text for r in got if r.doc_id is None] == ["no id at all but words"]
    elif name == "mixing":
        assert {str(r) for r in got} <= {str(r) for r in given}
    else:
        assert len(got) == len(given) and all(r.round_trip for r in got)
    assert stage(spark, odd.limit(0), odd_labels).count() == 0


def test_operators_take_odd_rows(spark, odd):
    from parlance.llm import bpe, pii, repetition, secrets, token_counts, toxicity

    for query in (bpe.query, pii.query, repetition.query, secrets.query, token_counts.query, simhash.query, mixing.query):
        assert query(odd).count() == odd.count() and query(odd.limit(0)).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.query(odd, none).count() == odd.count()


def test_pipeline_keeps_clean_documents_and_columns(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "near copies", "secrets", "mixing", "encoding"]
    stage = dict(P.STAGES)
    kept = stage["toxicity"](spark, docs, small)
    assert kept.columns == columns and kept.count() >= 0.7 * docs.count()
    labels = spark.read.parquet(f"{small}/labels.parquet").where("toxic = 0")
    clean = docs.join(labels, "doc_id", "left_semi")
    assert clean.join(kept, "doc_id", "left_semi").count() >= 0.9 * clean.count()
    masked = stage["secrets"](spark, docs, small)
    assert masked.columns == columns and masked.count() == docs.count()
    out = P.run(spark, small).collect()
    assert out and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in out)
    assert len({r.doc_id for r in out}) == len(out)
