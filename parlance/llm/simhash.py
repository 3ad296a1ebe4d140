"""SimHash near-duplicates: fingerprints, BK-tree links, components.

Every pair of fingerprints that differ in at most ``radius`` bits is linked, exactly:

* Equal texts collapse first: the search runs over distinct fingerprints.
* The 64 bits are cut into ``m`` blocks. Two fingerprints within the radius agree on at least
  ``m - radius`` whole blocks, so rows are dealt out once for each choice of that many blocks and
  only rows with equal blocks can be partners. ``m`` follows from the number of fingerprints, so that
  a bucket of evenly spread ones stays small at any size; no choice loses a pair.
* A bucket is searched with BK-trees: children are keyed by their integer Hamming distance to the
  parent, and a search follows only edges within the radius of its own distance. A bucket beyond
  ``SHARD_ROWS`` is cut into shards; every later shard's rows are sent to the trees of the earlier
  ones, so one bucket never lands in one task whole.
* A component needs no more than one link to each part of it. A subtree whose rows already are all in
  the searcher's own part is skipped, and each tree returns a spanning forest: at most one row per
  fingerprint, also for thousands of near copies.

``near_copies`` finds texts by shingle similarity instead of by a given number of bits, by the same steps. At
a similarity of 0.8 two fingerprints differ in some 15 % of their bits, and no exact cutting into blocks
reaches so far. So fingerprints of WIDE_BITS bits over distinct shingles are dealt out by samples of
their bits, as many as a pair at the limit needs to meet with the wanted recall; BK-trees over TREE_BITS other
bits search each bucket, and star contraction makes candidate groups of their links. A group of copies meets
again under nearly every key, so a few keys come first, and the trees of all others link only what these have
left apart. Inside a group the sets of shingles are compared exactly: no link stands on an estimate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import checkpointed, per_batch
from parlance.llm.components import connected_components

SHARD_ROWS = 50_000
_CHUNK = 65_536
_SALTS = 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one text's word shingles; 0 for a text without words.

    Words are the runs between bytes 0x20 and 0x09-0x0D after lower-casing A-Z; bytes.lower and
    bytes.split do exactly that. A bit is 1 if more than half of the shingle hashes have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + width - 1]
        hashes = np.array([digest(join(s), seed) for s in zip(*(part[k:] for k in range(width)))], ">u8")
        ones += np.add.reduce(np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64), axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, text_hash, fp)``, one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, width, seed) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))],
            ["doc_id", "text_hash", "fp"],
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.col("text").cast("string").alias("text"),
    )
    return per_batch(rows, over, "doc_id long, text_hash long, fp long")


class BKTree:
    """A BK-tree over distinct integers that keeps a union-find of the links found while it grows."""

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}
        self.parent: dict[int, int] = {}
        self.mixed: set[int] = set()  # nodes whose subtree spans more than one part

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def _link(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def search(self, x: int) -> None:
        """Link ``x`` with every part that holds a value within the radius."""
        self.parent.setdefault(x, x)
        if self.root is None:
            return
        radius, todo = self.radius, [self.root]
        while todo:
            node = todo.pop()
            if node not in self.mixed and self.find(node) == self.find(x):
                continue  # the whole subtree is in x's part already
            d = (node ^ x).bit_count()
            if d <= radius:
                self._link(node, x)
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)

    def add(self, x: int) -> None:
        """Search for ``x``, then store it. ``x`` must not be stored yet."""
        self.search(x)
        self.children[x] = {}
        if self.root is None:
            self.root = x
            return
        part, node = self.find(x), self.root
        while True:
            if self.find(node) != part:
                self.mixed.add(node)
            edges, d = self.children[node], (node ^ x).bit_count()
            if d not in edges:
                edges[d] = x
                return
            node = edges[d]

    def forest(self) -> Iterator[tuple[int, int]]:
        for x in self.parent:
            if (root := self.find(x)) != x:
                yield x, root


def _block_keys(fp: str, blocks: int, radius: int) -> F.Column:
    """An array of (choice, value): the bits of ``fp`` in every choice of ``blocks - radius`` blocks."""
    ends = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << ends[k + 1]) - 1) ^ ((1 << ends[k]) - 1) for k in range(blocks)]
    out = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[k] for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(i).alias("choice"), F.col(fp).bitwiseAND(F.lit(signed)).alias("value")))
    return F.array(*out)


def blocks_for(count: int, radius: int, per_bucket: int = 1000) -> int:
    """The least number of blocks that leaves ``per_bucket`` evenly spread fingerprints in a bucket."""
    blocks = radius + 1
    while blocks < 4 * radius + 4 and count / 2 ** (64 * (blocks - radius) / blocks) > per_bucket:
        blocks += 1
    return blocks


def links(distinct: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: links that connect what links within ``radius`` bits connect."""
    blocks = blocks_for(distinct.count(), radius)
    keyed = distinct.select("fp", F.explode(_block_keys("fp", blocks, radius)).alias("k")).select(
        "fp", "k.choice", "k.value"
    )
    sizes = keyed.groupBy("choice", "value").agg(F.count("*").alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / shard_rows).cast("int")
    dealt = (
        keyed.join(sizes, ["choice", "value"])
        .withColumn("own", F.pmod(F.xxhash64("fp"), shards).cast("int"))
        .select("fp", "choice", "value", "own", F.explode(F.sequence(F.lit(0), "own")).alias("shard"))
        .select("choice", "value", "shard", (F.col("own") != F.col("shard")).alias("probe"), "fp")
    )
    grouped = dealt.repartition("choice", "value", "shard").sortWithinPartitions("choice", "value", "shard", "probe")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(5)))

        a, b = [], []
        for _, group in groupby(rows(), key=lambda r: r[:3]):
            tree = BKTree(radius)
            for *_, probe, fp in group:
                (tree.search if probe else tree.add)(fp & 0xFFFFFFFFFFFFFFFF)
            for x, root in tree.forest():
                a.append(x)
                b.append(root)
            if len(a) >= 50_000:
                yield _pairs(a, b)
                a, b = [], []
        if a:
            yield _pairs(a, b)

    return grouped.mapInArrow(trees, "a long, b long")


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    sides = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(sides, ["a", "b"])


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, text_hash, fp, component_id, keep_hash)``, one row per row.

    ``component_id`` is the least doc_id of all rows that can be reached over links of ``radius`` bits
    or fewer, the row's own included; null doc_ids are passed over, and it is null if there is no
    other. ``keep_hash`` is the least text_hash among the rows that carry that id, so that
    (component_id, keep_hash) names one row, up to exact repetition. Null and empty texts, and texts
    of white space, have fingerprint 0 and link like any other. Repeated rows stay. Columns other than
    doc_id and text are not read. An empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs, width, seed))
    return _components(rows, links(rows.select("fp").distinct(), radius))


def _components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows(doc_id, text_hash, fp)`` with component_id and keep_hash, from links between values of fp."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # What has no link is its own part. A part may hold very many values of fp, so its rows are dealt out over
    # _SALTS tasks; what is joined to them is one row a part and task.
    linked = checkpointed(connected_components(edges))
    salt = F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(_SALTS)).cast("int").alias("salt")
    named = distinct.join(linked.withColumnRenamed("node", "fp"), "fp").select("fp", "first", "root", salt)
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    dealt = ids.select("*", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    parts = named.join(dealt, ["root", "salt"]).select("fp", "root", "component_id")
    of_fp = checkpointed(
        distinct.join(parts, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    )
    keep = (
        rows.join(of_fp, "fp")
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("text_hash").alias("keep_hash"))
    )
    again = keep.select("*", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    of_fp = of_fp.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(_SALTS)).cast("int")).join(again, ["root", "salt"], "left")
    return rows.join(of_fp.drop("root", "salt"), "fp").select("doc_id", "text_hash", "fp", "component_id", "keep_hash")


#: Bits of a wide fingerprint; the first TREE_BITS are searched by trees, samples of the others are keys.
WIDE_BITS, TREE_BITS = 1024, 128
#: Least bits in a key, and how surely a pair at the limit shares a key and lies within the trees' radius.
KEY_VALUES, KEY_RECALL, TREE_RECALL = 8, 0.996, 0.999
#: Evenly spread fingerprints in a bucket, about.
BUCKET_ROWS = 12
#: Keys that are searched before the others.
FIRST_KEYS = 4
#: Sets of fewer shingles have their differing bits counted out, as they differ from the limit of large ones.
SMALL_SET = 64
_LANES = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 for k in range(WIDE_BITS // 64)], np.uint64)
#: Shingles of a candidate group in one shard.
SHARD_SHINGLES = 4_000_000


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; of all its words if they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < width:
        return np.array([digest(join(words), 42)], np.uint64)
    return np.unique(np.array([digest(join(s), 42) for s in zip(*(words[k:] for k in range(width)))], np.uint64))


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """The SimHash of WIDE_BITS bits of a set of shingles; zeros for the empty set."""
    ones = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(shingles), 255):  # so many ones fit a byte
        h = (shingles[at : at + 255, None] ^ _LANES) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def _differing(a: int, b: int, both: int) -> float:
    """How likely a bit differs between sets of ``a`` and ``b`` shingles that have ``both`` in common."""

    def ones(n: int) -> np.ndarray:
        return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])

    def is_set(n: int) -> np.ndarray:
        own, shared = np.arange(n - both + 1), np.arange(both + 1)[:, None]
        return (2 * (shared + own) > n) @ ones(n - both)

    x, y = is_set(a), is_set(b)
    return float(ones(both) @ (x * (1 - y) + y * (1 - x)))


def differing_shares(similarity: float) -> np.ndarray:
    """By the number of shingles, the greatest share of bits in which a set and one of that similarity or more
    differ on average; the last value is for SMALL_SET or more shingles.

    Sums over many shingles are near normal, with a correlation of both / sqrt(a b), which is least for sets of
    one size: arccos(2 s / (1 + s)) / pi of the bits differ. The sizes before the last are counted out.
    """
    shares = np.zeros(SMALL_SET + 1)
    for a in range(1, SMALL_SET):
        for b in range(a, math.floor(a / similarity + 1e-9) + 1):
            both = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if both <= a:
                share, place = _differing(a, b, both), min(b, SMALL_SET)
                shares[a], shares[place] = max(shares[a], share), max(shares[place], share)
    large = math.acos(2 * similarity / (1 + similarity)) / math.pi
    shares[-1] = max(large, shares[SMALL_SET // 2 :].max())
    return shares


def keys_for(agreement: float, recall: float = KEY_RECALL, values: int = KEY_VALUES) -> int:
    """The number of keys of so many bits, sampled from the same WIDE_BITS - TREE_BITS, of which a pair shares one
    with ``recall``, if its bits agree with the probability ``agreement`` each."""
    if agreement >= 1:
        return 1
    of = WIDE_BITS - TREE_BITS
    k, logs = np.arange(of + 1), np.array([math.lgamma(n + 1) for n in range(of + 1)])
    chance = np.exp(logs[-1] - logs - logs[::-1] + k * math.log(agreement) + (of - k) * math.log(1 - agreement))
    missed, keys = 1 - (k / of) ** values, 1
    while chance @ missed**keys > 1 - recall:
        keys += 1
    return keys


def radius_for(share: float, recall: float = TREE_RECALL) -> int:
    """The least radius that holds a pair with ``recall``, if its bits differ with the probability ``share`` each."""
    within, radius = (1 - share) ** TREE_BITS, 0
    while within < recall:
        radius += 1
        within += math.comb(TREE_BITS, radius) * share**radius * (1 - share) ** (TREE_BITS - radius)
    return radius


def similar_links(distinct: DataFrame, similarity: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``distinct(wide, n)`` -> ``(a, b)``, the first 64 bits of two fingerprints: links that connect what links
    within the radius of the similarity connect, among fingerprints that share a key.

    n is the number of shingles; small sets get more keys. Buckets beyond ``shard_rows`` are cut into
    shards as in ``links``; they are told by a sample, which only decides how work is dealt out.

    The first FIRST_KEYS keys give each fingerprint as many links at most (where a bucket has shards, one in
    each). Under the others it goes by the group that these links put it in: the trees link groups, and none to
    itself.
    """
    shares = differing_shares(similarity)
    radius = radius_for(shares.max())

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        wide = batch.column("wide").to_pylist()
        name = pa.array(np.frombuffer(b"".join(w[:8] for w in wide), np.int64))
        return pa.RecordBatch.from_arrays([name, *(batch.column(k) for k in ("wide", "n"))], ["name", "wide", "n"])

    distinct = checkpointed(per_batch(distinct.select("wide", F.col("n").cast("long")), named, "name long, wide binary, n long"))
    bits = max(KEY_VALUES, round(math.log2(max(distinct.count(), 1) / BUCKET_ROWS)))
    needed = {s: keys_for(1 - s, values=bits) for s in set(shares.tolist())}
    tables = np.array([needed[s] for s in shares.tolist()])
    rng = np.random.default_rng(bits)
    places = np.stack([rng.choice(WIDE_BITS - TREE_BITS, bits, replace=False) for _ in range(tables.max())])

    def dealt_by(rows: DataFrame, turn: np.ndarray) -> DataFrame:
        """``(key, fp, more)`` and the group, if there is one, for the keys in ``turn``."""
        grouped = "group" in rows.columns

        def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint8).reshape(-1, WIDE_BITS // 8)
            sampled = np.unpackbits(raw[:, TREE_BITS // 8 :], axis=1)[:, places[turn]]
            made = sampled @ (1 << np.arange(bits, dtype=np.int64)) | turn << bits
            own = turn < tables[np.minimum(batch.column("n").to_numpy(), SMALL_SET)][:, None]
            row = np.nonzero(own)[0]
            fp = raw[:, : TREE_BITS // 8].copy().view(np.int64)[row]
            out = {"key": made[own], "fp": fp[:, 0], "more": fp[:, 1]}
            if grouped:
                out["group"] = batch.column("group").to_numpy()[row]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out.values()], list(out))

        return per_batch(rows, keys, "key long, fp long, more long" + ", group long" * grouped)

    turns, part = np.arange(len(places)), max(1, min(64, shard_rows // 64))
    sample = dealt_by(distinct.where(F.pmod(F.xxhash64("wide"), F.lit(part)) == 0), turns)
    large = checkpointed(
        sample.groupBy("key").agg(F.ceil(F.count("*") * part / shard_rows).cast("int").alias("shards")).where("shards > 1")
    )
    some = large.count()  # at least so many thousand rows of the table stand for each

    def linked(rows: DataFrame, turn: np.ndarray) -> DataFrame:
        dealt = dealt_by(rows, turn)
        if some:
            dealt = (
                dealt.join(F.broadcast(large) if some <= 100_000 else large, "key", "left")
                .withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp", "more"), "shards").cast("int"), F.lit(0)))
                .withColumn("shard", F.explode(F.sequence(F.lit(0), "own")))
                .withColumn("shard", F.col("shard").cast("long"))
                .withColumn("probe", (F.col("own") != F.col("shard")).cast("long"))
            )
        else:
            dealt = dealt.withColumn("shard", F.lit(0).cast("long")).withColumn("probe", F.lit(0).cast("long"))
        # One long holds shard, key and whether the row only searches, for short rows and a short sort.
        at = F.shiftleft("shard", 40).bitwiseOR(F.shiftleft("key", 1)).bitwiseOR(F.col("probe")).alias("at")
        group = ["group"] if "group" in rows.columns else []
        grouped = dealt.select(at, "fp", "more", *group).repartition(F.shiftright("at", 1)).sortWithinPartitions("at")
        return grouped.mapInArrow(trees, "a long, b long")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for at, fp, more, *known in _buckets(batches):
            group = known[0] if known else fp
            if (group == group[0]).all():
                continue
            tree = BKTree(radius)
            for probe, high, low, g in zip((at & 1).tolist(), *(c.view(np.uint64).tolist() for c in (fp, more, group))):
                x = high << 64 | low
                if x not in tree.parent:  # else sets that differ in keys only
                    # The union-find starts with the group; its name is negative there, as no fingerprint is.
                    tree.parent[x] = tree.parent.setdefault(~g, ~g)
                    (tree.search if probe else tree.add)(x)
            for x, root in tree.forest():
                if x < 0:
                    a.append(~x)
                    b.append(~root)
            if len(a) >= 50_000:
                yield _pairs(a, b)
                a, b = [], []
        if a:
            yield _pairs(a, b)

    if len(turns) <= FIRST_KEYS:
        return linked(distinct, turns)
    groups = connected_components(linked(distinct, turns[:FIRST_KEYS]))
    rows = distinct.join(groups.withColumnRenamed("node", "name"), "name", "left").select("wide", "n", F.coalesce("root", "name").alias("group"))
    return groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked(rows, turns[FIRST_KEYS:]))


def _buckets(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[list[np.ndarray]]:
    """The columns (at, fp, more, and what else there is) of every bucket with two rows or more, from rows in order
    of ``at``."""
    held, waiting, enough = [], 0, rows
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append([c.to_numpy() for c in batch.columns])
            waiting += batch.num_rows
            if waiting < enough:
                continue
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held)]
        bucket = columns[0] >> 1
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        end = waiting if batch is None else starts[-1]  # the last bucket may go on
        bounds = np.append(starts[starts < end], end)
        for k in np.flatnonzero(np.diff(bounds) > 1):
            yield [c[bounds[k] : bounds[k + 1]] for c in columns]
        held, waiting = [[c[end:] for c in columns]], waiting - end
        enough = rows + 2 * waiting


class Confirmed:
    """Sets of shingles, linked where their Jaccard similarity is the limit or more; exact.

    Two such sets share one of the first hashes of each: of n, those up to place n - ceil(limit n). So
    only sets that meet there are compared, and none of a part that is linked already.
    """

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity
        self.sets: dict[int, np.ndarray] = {}
        self.parent: dict[int, int] = {}
        self.met: dict[int, dict[int, list[int]]] = {}  # hash -> part when stored -> names

    find, _link, forest = BKTree.find, BKTree._link, BKTree.forest

    def _first(self, shingles: np.ndarray) -> list[int]:
        n = len(shingles)
        return shingles[: n - math.ceil(self.similarity * n - 1e-9) + 1].tolist()

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        least, most = sorted((len(a), len(b)))
        if least < self.similarity * most - 1e-9:
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= self.similarity * (least + most - both) - 1e-9

    def search(self, x: int, shingles: np.ndarray) -> None:
        """Link ``x`` with every part that holds a set similar to its own."""
        self.parent.setdefault(x, x)
        tested: set[int] = set()
        for h in self._first(shingles):
            for part, names in self.met.get(h, {}).items():
                for y in names:
                    if self.find(part) == self.find(x):
                        break
                    if y not in tested:
                        tested.add(y)
                        if self.similar(self.sets[y], shingles):
                            self._link(x, y)

    def add(self, x: int, shingles: np.ndarray) -> None:
        """Search for ``x``, then store it."""
        if x in self.sets:
            return
        self.search(x, shingles)
        self.sets[x] = shingles
        part = self.find(x)
        for h in self._first(shingles):
            self.met.setdefault(h, {}).setdefault(part, []).append(x)


def confirmed_links(docs: DataFrame, made: DataFrame, width: int, similarity: float, shard_shingles: int = SHARD_SHINGLES) -> DataFrame:
    """``made(doc_id, text_hash, fp, n, sim, wide)`` of ``docs`` -> ``(a, b)`` of fp: links that connect what exact
    comparison connects, within the groups that the trees' links make.

    Of each set one text is sent to its candidate group. A group beyond ``shard_shingles`` is cut into
    shards as in ``links``.
    """
    groups = connected_components(similar_links(made.select("wide", "n").distinct(), similarity))
    chosen = made.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row"), F.first("n").alias("n"), F.first("sim").alias("sim"))
    # Sets whose first 64 bits are equal are candidates, too.
    root = F.coalesce("root", "sim").alias("root")
    members = checkpointed(chosen.join(groups.withColumnRenamed("node", "sim"), "sim", "left").select("fp", root, "n", "row.*"))
    shards = members.groupBy("root").agg(F.ceil((F.sum("n") + 1) / shard_shingles).cast("int").alias("shards"), F.count("*").alias("m")).where("m > 1")
    sent = (
        members.join(shards, "root")
        .withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), "shards").cast("int"))
        .select("fp", "root", "own", F.col("none").alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash"))
    )
    texts = docs.select(
        F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), F.col("text").cast("string").alias("text"),
    )
    dealt = (
        texts.join(sent, ["_none", "_id", "_hash"])
        .select("fp", "root", "own", "text", F.explode(F.sequence(F.lit(0), "own")).alias("shard"))
        .select("root", "shard", (F.col("own") != F.col("shard")).alias("probe"), "fp", "text")
    )
    grouped = dealt.repartition("root", "shard").sortWithinPartitions("root", "shard", "probe")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(5)))

        for _, group in groupby(rows(), key=lambda r: r[:2]):
            sets = Confirmed(similarity)
            for *_, probe, fp, text in group:
                (sets.search if probe else sets.add)(fp, shingle_set(text, width))
            if found := list(sets.forest()):
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return grouped.mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Like ``near_duplicates``, for texts whose sets of word shingles have the Jaccard similarity or more.

    fp is the hash of the set. Candidates are found by SimHashes and their BK-trees, every link is confirmed
    on the sets. A pair at the limit becomes a candidate with KEY_RECALL times TREE_RECALL at least, closer ones
    with more; a candidate at the limit is never lost.
    """

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
        wide = [wide_fingerprint(s) for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("text_hash"),
                pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.frombuffer(b"".join(w[:8] for w in wide), np.int64)),
                pa.array(wide, pa.binary()),
            ],
            ["doc_id", "text_hash", "fp", "n", "sim", "wide"],
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.col("text").cast("string").alias("text"),
    )
    made = checkpointed(per_batch(rows, over, "doc_id long, text_hash long, fp long, n long, sim long, wide binary"))
    return _components(made.drop("n", "sim", "wide"), confirmed_links(docs, made, width, similarity))


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns kept, whatever their names.

    The row with the least doc_id stays (a null one if there is no other); among rows that share it, the one
    with the least text hash; of repeated rows one. Null and empty texts have no shingles and are copies of
    each other. An empty table gives an empty result.
    """
    keys = ["id", "no_id", "hash"]
    one = near_copies(docs, width, similarity).where(
        F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keep_hash"))
    )
    # Plain equalities on three columns: the join leaves the rows dealt out and sorted as the last
    # step needs them, so the texts are shuffled once.
    kept = one.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("text_hash").alias("hash")).distinct()
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(
        F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"),  # one struct, so no name can clash
        F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
    )
    return keyed.join(kept, keys).dropDuplicates(keys).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    """The rows of query op9: doc_id, fingerprint, component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
