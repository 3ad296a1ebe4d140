"""Toxic spans by a linear-chain conditional random field over tokens.

Labels exist for documents only, so tokens are labelled from them first: a feature that stands in many
toxic documents and next to no clean one, by a likelihood-ratio test, marks its tokens in toxic
documents. The field is then trained on these labelled tokens: emissions from a token's word and its
prefixes, and transitions between neighbouring labels. Forward-backward gives every token's marginal
probability; a document's score is a calibrated function of its marginals, and tokens that are likelier
toxic than not are returned as offsets. The calibration is fitted on documents that the field at hand
has not seen: the sample is cut into folds, and each is scored by a field trained on the others.

Training takes a bounded sample of labelled rows (``Sample``); scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import checkpointed, held_out, per_batch

TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_PREFIXES = (3, 4, 5, 6, 7, 8)
_BLOCK = 64
MEMORY = 500_000
#: Tokens that go through forward-backward at once.
_STREAM = 400_000


@dataclass(frozen=True)
class Sample:
    """The bound on labelled rows for training: so many of each label, of at most so many characters, and so many
    clean ones in all to tell the words of toxic texts from others.

    The rows are those with the least hashes of their ids. At most (per_label + clean) * max_chars
    characters (80 million with these values) reach the driver, at any size of the input.
    """

    per_label: int = 800
    clean: int = 3200
    max_chars: int = 20_000


def features(token: str) -> list[str]:
    """A token's word and prefixes, lower-cased."""
    low = token.lower()
    return [low, *(f"{low[:k]}*" for k in _PREFIXES if len(low) > k)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # emission log-odds by feature; others weigh nothing
    bias: float
    transition: np.ndarray  # exp of the 2 x 2 potentials
    calibration: tuple[float, float, float]

    def emission(self, token: str) -> float:
        w = self.weights
        return self.bias + sum(w[f] for f in features(token) if f in w)


def forward_backward(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1 for tokens of many sequences in one stream.

    ``emission``: log-odds of label 1 for each token; ``first``: which tokens begin a sequence. Returns
    (marginal, alpha, beta), each message scaled to sum 1. The stream is cut into blocks of 64 tokens.
    Block products are formed for all blocks at once, messages at block ends follow one after another,
    and the messages within blocks again for all blocks at once. A sequence's first step has equal
    rows, which forgets what came before it, so neither padding nor a text's length matters.
    """
    n = len(emission)
    blocks = -(-n // _BLOCK)
    pot = np.ones((blocks * _BLOCK, 2, 2))
    odds = np.exp(np.clip(emission, -30, 30))
    pot[:n] = np.where(first[:, None, None], 1.0, transition)
    pot[:n, :, 1] *= odds[:, None]
    pot[:n] /= pot[:n].sum(axis=(1, 2), keepdims=True)
    step = pot.reshape(blocks, _BLOCK, 2, 2).transpose(1, 0, 2, 3).copy()
    product = step[0]
    for k in range(1, _BLOCK):
        product = product @ step[k]
        product /= product.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((blocks, 2)), np.empty((blocks, 2))
    a0 = a1 = b0 = b1 = 0.5
    cells = product.reshape(blocks, 4).tolist()
    for i, (p, q, r, s) in enumerate(cells):
        enter[i] = a0, a1
        a0, a1 = a0 * p + a1 * r, a0 * q + a1 * s
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    for i in range(blocks - 1, -1, -1):
        leave[i] = b0, b1
        p, q, r, s = cells[i]
        b0, b1 = p * b0 + q * b1, r * b0 + s * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    alpha, beta = np.empty((_BLOCK, blocks, 2)), np.empty((_BLOCK, blocks, 2))
    message = enter
    for k in range(_BLOCK):
        message = message[:, :1] * step[k][:, 0] + message[:, 1:] * step[k][:, 1]
        message /= message.sum(axis=1, keepdims=True)
        alpha[k] = message
    message = leave
    for k in range(_BLOCK - 1, -1, -1):
        beta[k] = message
        message = step[k][:, :, 0] * message[:, :1] + step[k][:, :, 1] * message[:, 1:]
        message /= message.sum(axis=1, keepdims=True)
    alpha = alpha.transpose(1, 0, 2).reshape(-1, 2)[:n]
    beta = beta.transpose(1, 0, 2).reshape(-1, 2)[:n]
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), alpha, beta


class _Telling:
    """Which features tell toxic documents from clean ones, counted once for every choice of folds.

    A feature is taken with a likelihood ratio of at least ``least``, if it is a tenth as common in clean
    documents. A toxic document counts only if the feature stands between neighbours (two words on either side)
    that it had in none before: the words of a text or passage that is copied from one toxic document to
    others always stand between the same words.
    """

    def __init__(
        self, documents: list[list[str]], labels: np.ndarray, fold: np.ndarray, folds: int, more: Iterable[list[str]] = (), least: float = 20.0
    ) -> None:
        """``more``: further clean documents, in no fold; they are read once and not kept."""
        self.documents, self.labels, self.fold, self.least = documents, labels, fold, least
        of: dict[str, list[str]] = {}
        seen = [Counter() for _ in range(folds)]
        for tokens, y, k in zip(documents, labels.tolist(), fold.tolist(), strict=True):
            if y:
                seen[k].update({f for t in set(tokens) for f in (of.get(t) or of.setdefault(t, features(t)))})
        every = Counter()
        for counts in seen:
            every.update(counts)
        # Only what three toxic documents hold can be telling, so nothing else is counted in clean ones.
        self.number = {f: i for i, f in enumerate(f for f, k in every.items() if k > 2)}
        self.toxic, self.clean = np.zeros((folds, len(self.number)), np.int64), np.zeros((folds + 1, len(self.number)), np.int64)
        for k, counts in enumerate(seen):
            for f, n in counts.items():
                if f in self.number:
                    self.toxic[k, self.number[f]] = n
        self.more = 0

        def count(tokens: list[str], k: int) -> None:
            own = {self.number[f] for t in set(tokens) for f in features(t) if f in self.number}
            self.clean[k, list(own)] += 1

        for tokens, y, k in zip(documents, labels.tolist(), fold.tolist(), strict=True):
            if not y:
                count(tokens, k)
        for tokens in more:
            count(tokens, folds)
            self.more += 1

    def without(self, left_out: int | None) -> set[str]:
        """The telling features of all documents but those of one fold."""
        rows = np.ones(len(self.fold), bool) if left_out is None else self.fold != left_out
        others = [k for k in range(len(self.toxic)) if k != left_out]
        toxic, clean = self.toxic[others].sum(axis=0), self.clean[[*others, len(self.toxic)]].sum(axis=0)
        n1 = float(self.labels[rows].sum())
        n0 = float(rows.sum()) - n1 + self.more

        def passes(k1: np.ndarray) -> np.ndarray:
            k0, rate = clean, (k1 + clean) / (n1 + n0)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = 2 * (k1 * np.log(k1 / n1 / rate) + np.where(k0 > 0, k0 * np.log(k0 / n0 / rate), 0))
                ratio += 2 * ((n1 - k1) * np.log(np.maximum(1e-12, (1 - k1 / n1) / (1 - rate))) + (n0 - k0) * np.log((1 - k0 / n0) / (1 - rate)))
            return (k1 > 2) & (k0 * n1 <= 0.1 * k1 * n0) & (ratio >= self.least)

        names = list(self.number)
        lefts: dict[str, set[tuple[str, str]]] = {names[i]: set() for i in np.flatnonzero(passes(toxic))}
        rights: dict[str, set[tuple[str, str]]] = {f: set() for f in lefts}
        held = np.zeros(len(names), np.int64)
        for i in np.flatnonzero(rows & (self.labels == 1)).tolist():
            around, found = ["", "", *(t.lower() for t in self.documents[i]), "", ""], {}
            for at, t in enumerate(self.documents[i]):
                for f in features(t):
                    if f in lefts:
                        found.setdefault(f, []).append((tuple(around[at : at + 2]), tuple(around[at + 3 : at + 5])))
            for f, places in found.items():
                held[self.number[f]] += any(x not in lefts[f] and y not in rights[f] for x, y in places)
                lefts[f].update(x for x, _ in places)
                rights[f].update(y for _, y in places)
        return {names[i] for i in np.flatnonzero(passes(held))}


def _summary(marginal: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: ln(1 + expected toxic tokens), and the same per thousand tokens, 100 more counted."""
    total = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        total[some] = np.add.reduceat(marginal, starts[some])
    return np.stack([np.log1p(total), np.log1p(1000 * total / (lengths + 100))], axis=1)


@dataclass(frozen=True)
class _Stream:
    """Documents as one stream of tokens, by the numbers of distinct tokens."""

    tokens: list[str]
    of: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def _stream(documents: list[list[str]]) -> _Stream:
    number: dict[str, int] = {}
    of = np.array([number.setdefault(t, len(number)) for d in documents for t in d], np.int64)
    lengths = np.array([len(d) for d in documents], np.int64)
    starts = np.cumsum(lengths) - lengths
    first = np.zeros(len(of), bool)
    first[starts[lengths > 0]] = True
    return _Stream(list(number), of, first, starts, lengths)


#: Tokens whose messages and pair marginals are held at once in training.
_PART = 65_536


def _field(s: _Stream, y: np.ndarray, telling: set[str], rounds: int) -> Model:
    """The conditional random field by AdaGrad on the likelihood of the token labels; not calibrated yet."""
    number: dict[str, int] = {}
    own = [[number.setdefault(f, len(number)) for f in features(t)] for t in s.tokens]
    marked = np.array([not telling.isdisjoint(features(t)) for t in s.tokens], bool)
    truth = marked[s.of] & np.repeat(y, s.lengths).astype(bool)
    width = 1 + len(_PREFIXES)
    ids = np.full((len(own), width), len(number), np.int64)  # by distinct token; the last id is no feature
    for i, found in enumerate(own):
        ids[i, : len(found)] = found
    weights, bias, trans = np.zeros(len(number) + 1), -4.0, np.zeros((2, 2))
    grad_sq, trans_sq, bias_sq = np.full(len(number) + 1, 1e-6), np.full((2, 2), 1e-6), 1e-6
    before = np.concatenate([[0], truth[:-1].astype(int)])
    inner = ~s.first
    seen = np.zeros((2, 2))
    np.add.at(seen, (before[inner], truth[inner].astype(int)), 1)
    cuts = [0]  # parts of the stream that end with a document
    for end in (s.starts + s.lengths).tolist():
        if end - cuts[-1] >= _PART:
            cuts.append(end)
    cuts += [len(s.of)] * (cuts[-1] < len(s.of))
    for _ in range(rounds):
        of_token = weights[ids].sum(axis=1) + bias
        by_token, expected, total = np.zeros(len(own)), np.zeros((2, 2)), 0.0
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            part, first = s.of[begin:end], s.first[begin:end]
            emission = of_token[part]
            marginal, alpha, beta = forward_backward(emission, first, np.exp(trans))
            err = truth[begin:end] - marginal
            by_token += np.bincount(part, err, len(own))
            total += err.sum()
            odds = np.stack([np.ones(len(part) - 1), np.exp(np.clip(emission[1:], -30, 30))], 1)
            pair = alpha[:-1, :, None] * np.exp(trans) * (beta[1:] * odds)[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            expected += pair[~first[1:]].sum(axis=0)
        g = np.bincount(ids.ravel(), np.repeat(by_token, width), len(number) + 1) - 0.05 * weights
        g[-1] = 0
        gt = seen - expected - 0.05 * trans
        gb = total - 0.05 * bias
        grad_sq, trans_sq, bias_sq = grad_sq + g * g, trans_sq + gt * gt, bias_sq + gb * gb
        weights += 0.7 * g / np.sqrt(grad_sq)
        trans += 0.2 * gt / np.sqrt(trans_sq)
        bias += 0.3 * gb / np.sqrt(bias_sq)
    names = list(number)
    kept = {names[i]: float(weights[i]) for i in np.flatnonzero(np.abs(weights[:-1]) > 0.02)}
    return Model(kept, float(bias), np.exp(trans), (0.0, 0.0, 0.0))


def _summaries(model: Model, s: _Stream) -> np.ndarray:
    if not len(s.of):
        return _summary(np.zeros(0), s.starts, s.lengths)
    by_token = np.array([model.emission(t) for t in s.tokens])
    return _summary(forward_backward(by_token[s.of], s.first, model.transition)[0], s.starts, s.lengths)


def train(
    texts: list[str], labels: Iterable[int], prior: float | None = None, clean: list[str] = (), rounds: int = 25, folds: int = 3
) -> Model:
    """A model from labelled documents. ``prior``: share of toxic documents where it is to be used; ``clean``:
    further clean documents, only to tell the words of toxic ones from others."""
    y = np.array(list(labels), int)
    documents = [TOKEN.findall(t) for t in texts]
    if not len(y) or y.all() or not y.any() or not any(documents):
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, -8.0, np.ones((2, 2)), (float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0, 0.0))
    # By the least hash of its five-word windows, so that copies of a text are in one fold.
    least = [min((crc32(" ".join(d[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(d) - 4))), default=0) for d in documents]
    fold = np.array(least) % folds
    words = _Telling(documents, y, fold, folds, map(TOKEN.findall, clean))

    def field(left_out: int | None) -> Model:
        rows = np.flatnonzero(fold != left_out) if left_out is not None else np.arange(len(y))
        return _field(_stream([documents[i] for i in rows]), y[rows], words.without(left_out), rounds)

    x = np.ones((len(y), 3))
    whole = field(None)
    for k in range(folds):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not len(own):
            continue
        usable = 0 < y[rest].sum() < len(rest) and any(documents[i] for i in rest)
        x[own, 1:] = _summaries(field(k) if usable else whole, _stream([documents[i] for i in own]))
    share = float(y.mean())
    prior = share if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    importance = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    c = np.zeros(3)
    for _ in range(60):  # logistic regression, lightly held down, by damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        slope = x.T @ (importance * (p - y)) + np.array([0.0, 0.1, 0.1]) * c
        curve = (x * (importance * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1])
        move = np.linalg.solve(curve, slope)
        c -= move * min(1.0, 3.0 / max(1e-9, float(np.abs(move).max())))
    return replace(whole, calibration=tuple(float(v) for v in c))


class Scorer:
    """A model at work in one Python worker, with a memory of tokens' emissions."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def marginals(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginals in one stream, where each document begins in it, its length)."""
        known, emission = self.known, self.model.emission
        if len(known) > MEMORY:
            known.clear()
        parts = []
        for tokens in documents:
            for t in set(tokens).difference(known):
                known[t] = emission(t)
            parts.append(np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens)))
        lengths = np.array([len(p) for p in parts])
        starts = np.cumsum(lengths) - lengths
        stream = np.concatenate(parts) if parts else np.zeros(0)
        if not len(stream):
            return stream, starts, lengths
        first = np.zeros(len(stream), bool)
        first[starts[lengths > 0]] = True
        return forward_backward(stream, first, self.model.transition)[0], starts, lengths

    def score(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int]]]]:
        """Each text's score and its toxic spans, in code points."""
        out: list[tuple[float, list[tuple[int, int]]]] = []
        group: list[list[str]] = []
        at, size = 0, 0
        for i, t in enumerate(texts):
            tokens = TOKEN.findall(t)
            group.append(tokens)
            size += len(tokens)
            if size >= _STREAM or i == len(texts) - 1:
                out += self._scored(texts[at : i + 1], group)
                group, at, size = [], i + 1, 0
        return out

    def _scored(self, texts: list[str], documents: list[list[str]]) -> list[tuple[float, list[tuple[int, int]]]]:
        marginal, starts, lengths = self.marginals(documents)
        a, b, c = self.model.calibration
        x = _summary(marginal, starts, lengths)
        scores = 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -50, 50)))
        out = []
        for text, start, n, score in zip(texts, starts.tolist(), lengths.tolist(), scores.tolist(), strict=True):
            spans: list[tuple[int, int]] = []
            own = marginal[start : start + n] >= 0.5
            if own.any():
                spans = [m.span() for m, hit in zip(TOKEN.finditer(text), own.tolist(), strict=True) if hit]
            out.append((score, spans))
        return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """Train on a bounded sample of ``docs`` that ``labels(doc_id, toxic)`` marks, held-out ids left out.

    Null ids and null labels are passed over; a doc_id with several labels is toxic if one of them is. Texts
    that occur several times are taken once, as toxic if one of their rows is.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    hashed = _rows(docs).where(F.length("text") <= sample.max_chars).withColumn("hash", F.xxhash64("text"))
    # Long texts are left out before the sample is drawn; only ids and hashes are looked at for it.
    known = checkpointed(
        marked.join(hashed.select("doc_id", "hash"), "doc_id").groupBy("hash").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("toxic") == y).orderBy(*order).limit(n) for y, n in ((0, max(sample.clean, sample.per_label)), (1, sample.per_label))]
    picked = chosen[0].unionByName(chosen[1])  # at most per_label + clean ids, so it may be broadcast
    found = hashed.join(F.broadcast(picked), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("doc_id", "toxic", "text", order[0].alias("h")).collect()
    found.sort(key=lambda r: (r.h, r.doc_id))
    clean, toxic = ([r.text for r in found if r.toxic == y] for y in (0, 1))
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else None
    own = clean[: sample.per_label]
    return train([*own, *toxic], [0] * len(own) + [1] * len(toxic), prior, clean[sample.per_label :])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, held_out, score, predicted, spans), one row per row.

    score: probability of the toxic label; predicted: 1 if score >= threshold; spans: offending
    ``start:end`` in code points, comma-joined. Null and empty texts have no tokens and get the score of
    an empty text. Null doc_ids are not held out. Repeated rows stay; other columns are not read. An empty
    table gives an empty result.
    """

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = worker(model).score([t or "" for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("held_out"), pa.array([s for s, _ in found], pa.float64()),
                pa.array([int(s >= threshold) for s, _ in found], pa.int32()),
                pa.array([",".join(f"{a}:{b}" for a, b in spans) for _, spans in found], pa.string()),
            ],
            ["doc_id", "held_out", "score", "predicted", "spans"],
        )

    rows = _rows(docs).withColumn("held_out", held_out("doc_id"))
    return per_batch(rows, over, "doc_id long, held_out boolean, score double, predicted int, spans string")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept, whatever their names.

    A null text scores as an empty one; repeated rows stay. An empty table gives an empty result.
    """

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = worker(model).score([t or "" for t in batch.column("text").to_pylist()])
        return batch.filter(pa.array([s < threshold for s, _ in found], pa.bool_()))

    return per_batch(docs, over, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


_WORKER: list[Scorer] = []


def worker(model: Model) -> Scorer:
    """This worker's scorer for ``model``; a worker that gets another model starts anew."""
    if not _WORKER or _WORKER[0].model is not model and _WORKER[0].model.weights != model.weights:
        _WORKER[:] = [Scorer(model)]
    return _WORKER[0]


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of query op1."""
    return score(docs, fit(docs, labels))
