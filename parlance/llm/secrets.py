"""Secret scans: expressions propose spans, a character convolutional network judges each of them.

The network reads every candidate whole, with the characters around it. It is trained on labelled
findings from the corpus at hand (``fit``): what the expressions find in a bounded sample of documents,
labelled by validators (``label``: form, placeholders, entropy), and, as real tables hold few sorts of
credentials, strings made by rule (also passwords made of words) that are put into the sample's own
contexts. Half of the findings are held out from training: on them the scores are calibrated, and two
thresholds are the highest that still find a required share of the credentials: ``threshold`` for what
the network adds, and the lower ``clear``, below which a span that an expression found counts as harmless.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import per_batch

#: The base expressions, in the order in which kinds are listed.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What the method adds: key blocks, and long unbroken tokens that hold digits and letters.
_KEYBLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z0-9 ]*PRIVATE KEY-----)?")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "keyblock", "opaque")
_ORDER = {k: i for i, k in enumerate(KINDS)}

CONTEXT = 24
_WIDTH, _FILTERS, _DIM, _LENGTH = 5, 24, 8, 96


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], _ORDER[s[2]]))


def added_candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further candidates that overlap no base span."""
    found = []
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), m.end(), "keyblock") for m in _KEYBLOCK.finditer(text)]
    for m in _OPAQUE.finditer(text):
        token = m[0]
        if not token.isalpha() and any(map(str.isdigit, token)) and any(map(str.isalpha, token)):
            found.append((m.start(), m.end(), "opaque"))
    out, at = [], 0
    spans = sorted(taken)
    for start, end, kind in sorted(found):
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if at == len(spans) or spans[at][0] >= end:
            out.append((start, end, kind))
    return out


_CODES = np.full(65_536, 2, np.uint8)  # 0 padding, 1 reserved, 2 any other character
for _i, _c in enumerate(string.printable):
    _CODES[ord(_c)] = 3 + _i
_SYMBOLS = 3 + len(string.printable)


@dataclass(frozen=True)
class Model:
    embed: np.ndarray  # (codes, dim); the last channel of the input marks the candidate itself
    kernel: np.ndarray  # (width * (dim + 1), filters)
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    scale: float  # calibration: probability = sigmoid(scale * logit + shift)
    shift: float
    threshold: float  # an added candidate is a finding from here on
    clear: float  # a base span is harmless below


@dataclass(frozen=True)
class Sample:
    """The bound on training: so many documents with a finding and as many of any sort (those whose texts have the
    least hash of each residue, of at most so many characters each), and so many findings made by rule.

    At most 2 * documents * max_chars characters (20 million with these values) reach the driver.
    """

    documents: int = 500
    max_chars: int = 20_000
    made: int = 4000
    found: int = 2000


def _segments(findings: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, candidate, right) strings -> codes, inside marks (segments x _LENGTH), owner of each segment.

    A long candidate takes several segments that overlap by one kernel, so all of it is read.
    """
    codes, inside, owner = [], [], []
    step = _LENGTH - _WIDTH + 1
    for i, (left, body, right) in enumerate(findings):
        whole = left + body + right
        raw = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        code = _CODES[np.minimum(raw, 65_535)]
        mark = np.zeros(len(whole), np.float32)
        mark[len(left) : len(left) + len(body)] = 1
        for at in range(0, max(1, len(whole) - _WIDTH + 1), step):
            c, m = np.zeros(_LENGTH, np.uint8), np.zeros(_LENGTH, np.float32)
            part = code[at : at + _LENGTH]
            c[: len(part)], m[: len(part)] = part, mark[at : at + _LENGTH]
            codes.append(c)
            inside.append(m)
            owner.append(i)
    return np.array(codes), np.array(inside), np.array(owner)


def _windows(codes: np.ndarray, inside: np.ndarray, embed: np.ndarray) -> np.ndarray:
    x = np.concatenate([embed[codes], inside[..., None]], axis=2)
    view = np.lib.stride_tricks.sliding_window_view(x, _WIDTH, axis=1)
    return view.transpose(0, 1, 3, 2).reshape(len(codes), _LENGTH - _WIDTH + 1, -1)


def _pooled(model: Model, findings: list[tuple[str, str, str]]) -> np.ndarray:
    codes, inside, owner = _segments(findings)
    best = np.empty((len(codes), _FILTERS), np.float32)
    for at in range(0, len(codes), 256):
        part = slice(at, at + 256)
        best[part] = (_windows(codes[part], inside[part], model.embed) @ model.kernel + model.bias).max(axis=1)
    starts = np.searchsorted(owner, np.arange(len(findings)))
    return np.maximum(np.maximum.reduceat(best, starts, axis=0), 0)


def logits(model: Model, findings: list[tuple[str, str, str]]) -> np.ndarray:
    return _pooled(model, findings) @ model.dense + model.offset


def probabilities(model: Model, findings: list[tuple[str, str, str]]) -> np.ndarray:
    """The calibrated probability that each (left, candidate, right) is a credential."""
    if not findings:
        return np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(model.scale * logits(model, findings) + model.shift, -50, 50)))


#: Values that stand for a credential without being one.
_PLACEHOLDERS = (
    "changeme", "change_me", "example", "placeholder", "xxxxxxxx", "required", "undefined", "yourpassword", "your_token_here",
    "my-secret-here", "password", "redacted", "removed", "********", "<token>", "process.env.TOKEN", "os.environ",
)


def entropy(text: str) -> float:
    """Bits a character, by the text's own frequencies."""
    counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1]
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def label(kind: str, body: str) -> int | None:
    """What validators say of a candidate found in a text: 1 a credential, 0 harmless, None undecided."""
    if kind in ("access", "keyblock"):
        return 1 if entropy(body[-20:]) >= 2.5 else 0
    if kind == "hex":
        return 1 if entropy(body) >= 2.8 else 0
    if kind == "assign":
        value = _ASSIGN.match(body)[2]
        if value.lower() in _PLACEHOLDERS or entropy(value) < 1.5:
            return 0
        return 1 if any(map(str.isdigit, value)) and entropy(value) >= 2.8 else None
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:]))
    return 1 if turns >= 6 and entropy(body) >= 3.8 else 0 if turns <= 2 and body in (body.lower(), body.upper()) else None


def corpus_findings(texts: list[str], most: int) -> tuple[list[tuple[str, str, str]], list[int], list[tuple[str, str]]]:
    """(findings, their labels, contexts) of texts, at most ``most`` each; a context is the text before and after a gap."""
    findings, labels, contexts = [], [], []
    for text in texts:
        base = base_spans(text)
        for start, end, kind in sorted([*base, *added_candidates(text, base)]):
            y = label(kind, text[start:end])
            if y is not None:
                findings.append((text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]))
                labels.append(y)
        gaps = [m.start() for m in re.finditer(r"\s", text)]
        contexts += [(text[max(0, g + 1 - CONTEXT) : g + 1], text[g : g + CONTEXT]) for g in gaps[:: max(1, len(gaps) // 4)]]
    return findings[:most], labels[:most], contexts[:most]


def labelled_findings(n: int, seed: int, contexts: list[tuple[str, str]] = ()) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """n findings made by rule and their labels (1: a credential), half of each, in ``contexts`` if there are any."""
    rng = np.random.default_rng(seed)
    vowels, consonants = "aeiou", "bcdfghklmnprstvwz"

    def pick(alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))

    def one(options):
        return options[rng.integers(0, len(options))]

    def word() -> str:
        return "".join(pick(consonants, 1) + pick(vowels, 1) + one(("", "", pick(consonants, 1))) for _ in range(rng.integers(2, 4)))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def spelled(k: int) -> str:
        """A password made of words: joined or with a capital, a year, a sign, a letter turned into a digit."""
        made = "".join(word() for _ in range(k))
        made = one((made, made.capitalize(), made.replace("o", "0"), made.replace("e", "3")))
        return made + one(("", str(rng.integers(0, 100)), str(rng.integers(1950, 2031)), "_" + pick(string.digits, 2)))

    secret, loose = ("password", "passwd", "PASSWORD", "Password"), ("secret", "token", "api_key", "apikey", "API_KEY", "Secret")
    joins, alnum, hexed = (" = ", "=", ": ", '="', ' = "', "='", ":"), string.ascii_letters + string.digits, "0123456789abcdef"
    made, labels = [], []
    for i in range(n):
        left, right = one(contexts) if contexts else (prose(6)[-CONTEXT:] + " ", " " + prose(6)[:CONTEXT])
        kind, name, join = rng.integers(0, 9), one(secret + loose), one(joins)
        if i % 2:  # credentials
            if kind == 0:
                body = "AKIA" + pick(string.ascii_uppercase + string.digits, 16)
            elif kind == 1:
                body = pick(hexed, int(one((24, 32, 40, 48, 64))))
            elif kind == 2:
                body = pick(alnum + "+/", int(rng.integers(20, 64))) + "=" * int(rng.integers(0, 3))
            elif kind == 3:
                body = name + join + pick(hexed, int(one((24, 32, 40))))
            elif kind == 4:
                body = one(("ghp_", "sk-", "xoxb-", "glpat-")) + pick(alnum, int(rng.integers(20, 40)))
            elif kind == 5:
                body = "-----BEGIN PRIVATE KEY-----\n" + pick(alnum + "+/", 64) + "\n" + pick(alnum + "+/", 64)
            elif kind == 6:
                body = name + join + pick(alnum + "_-", int(rng.integers(8, 40)))
            elif kind == 7:
                body = one(secret) + join + spelled(int(rng.integers(1, 4)))
            else:
                body = one(loose) + join.strip(" ") + spelled(int(rng.integers(2, 5)))
        else:  # harmless look-alikes
            if kind in (0, 6):
                body = name + join + one(_PLACEHOLDERS)
            elif kind == 1:
                body = one(loose) + ": " + word()
            elif kind == 2:
                body = "-".join(word() for _ in range(rng.integers(4, 8))) + "-" + str(rng.integers(1, 2030))
            elif kind == 3:
                body = "/" + "/".join(word() for _ in range(rng.integers(4, 7))) + "/" + str(rng.integers(0, 99999))
            elif kind == 4:
                body = one(("0", "f", "a", "0123456789")) * int(rng.integers(24, 40))
            elif kind == 5:
                body = "_".join(word() for _ in range(rng.integers(4, 8))) + str(rng.integers(0, 100))
            elif kind == 7:
                body = one((*secret, *loose)) + join + one("x*._-") * int(rng.integers(6, 20))
            else:
                body = "".join(word() for _ in range(6)) + str(rng.integers(1900, 2030))
        made.append((left[-CONTEXT:], body, right[:CONTEXT]))
        labels.append(i % 2)
    return made, np.array(labels, np.float32)


def train(
    findings: list[tuple[str, str, str]], y: np.ndarray, held: list[tuple[str, str, str]], truth: np.ndarray,
    recall: float = 0.99, sure: float = 0.999, epochs: int = 6, seed: int = 7,
) -> Model:
    """The network from labelled ``findings``, calibrated on the ``held`` ones; the same each time.

    ``recall``: the share of held-out credentials that ``threshold`` must find; ``sure``: that ``clear`` must.
    """
    rng, n = np.random.default_rng(seed), len(findings)
    codes, inside, owner = _segments(findings)
    first = np.searchsorted(owner, np.arange(n))  # one segment of each: the first of a long one
    codes, inside = codes[first], inside[first]
    p = {
        "embed": rng.normal(0, 0.3, (_SYMBOLS, _DIM)), "kernel": rng.normal(0, 0.15, (_WIDTH * (_DIM + 1), _FILTERS)),
        "bias": np.zeros(_FILTERS), "dense": rng.normal(0, 0.2, _FILTERS), "offset": np.zeros(1),
    }
    p["embed"][0] = 0
    first_moment, second_moment, t = *({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2)), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            rows = order[at : at + 64]
            x = _windows(codes[rows], inside[rows], p["embed"])
            act = x @ p["kernel"] + p["bias"]
            arg = act.argmax(axis=1)
            top = np.take_along_axis(act, arg[:, None, :], axis=1)[:, 0, :]
            pooled = np.maximum(top, 0)
            err = 1 / (1 + np.exp(-(pooled @ p["dense"] + p["offset"]))) - y[rows]
            err /= len(rows)
            back = (err[:, None] * p["dense"]) * (top > 0)
            at_max = np.take_along_axis(x, arg[:, :, None], axis=1)  # rows x filters x taps
            taps = np.einsum("rf,ft->rft", back, p["kernel"].T).reshape(len(rows), _FILTERS, _WIDTH, _DIM + 1)
            embed = np.zeros_like(p["embed"])
            place = arg[:, :, None] + np.arange(_WIDTH)
            np.add.at(embed, np.take_along_axis(codes[rows][:, None, :], place, axis=2), taps[..., :_DIM])
            embed[0] = 0
            grads = {
                "embed": embed, "kernel": np.einsum("rf,rft->tf", back, at_max), "bias": back.sum(axis=0),
                "dense": pooled.T @ err + 1e-4 * p["dense"], "offset": err.sum(keepdims=True),
            }
            t += 1
            for k, g in grads.items():
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
                step = first_moment[k] / (1 - 0.9**t) / (np.sqrt(second_moment[k] / (1 - 0.999**t)) + 1e-8)
                p[k] = p[k] - 0.01 * step
    raw = Model(*(p[k].astype(np.float32) for k in ("embed", "kernel", "bias", "dense")), float(p["offset"][0]), 1.0, 0.0, 0.5, 0.5)
    z = logits(raw, held).astype(float)
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Platt's two parameters, by Newton's method
        q = 1 / (1 + np.exp(-np.clip(scale * z + shift, -50, 50)))
        g = np.array([((q - truth) * z).sum() + 0.5 * (scale - 1), (q - truth).sum()])
        w = q * (1 - q) + 1e-9
        h = np.array([[(w * z * z).sum() + 0.5, (w * z).sum()], [(w * z).sum(), w.sum()]])
        scale, shift = np.array([scale, shift]) - np.linalg.solve(h, g)
    q = 1 / (1 + np.exp(-np.clip(scale * z + shift, -50, 50)))
    found = np.sort(q[truth == 1])
    threshold, clear = (float(found[int((1 - share) * len(found))]) if len(found) else 0.5 for share in (recall, sure))
    return replace(raw, scale=float(scale), shift=float(shift), threshold=threshold, clear=min(clear, threshold))


def trained(texts: list[str] = (), sample: Sample = Sample(), seed: int = 7) -> Model:
    """The network for the sampled ``texts``: findings in them and made ones, every second held out."""
    findings, labels, contexts = corpus_findings(list(texts), sample.found)
    made, y = labelled_findings(sample.made, seed, contexts)
    # Made findings alternate between the labels, so pairs of them are dealt out.
    part = np.concatenate([np.arange(len(made)) // 2 % 2, np.arange(len(findings)) % 2])
    every, truth = [*made, *findings], np.concatenate([y, np.array(labels, np.float32)])
    kept, rest = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    return train([every[i] for i in kept], truth[kept], [every[i] for i in rest], truth[rest], seed=seed)


def fit(docs: DataFrame, sample: Sample = Sample()) -> Model:
    """The network for a corpus, from a bounded sample of ``docs(text)``. Null and empty texts are passed over."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where((F.length("text") > 0) & (F.length("text") <= sample.max_chars))
    shaped = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA|(?<![0-9a-f])[0-9a-f]{24}|PRIVATE KEY-----"
    texts = texts.withColumn("h", F.xxhash64("text"))

    def few(rows: DataFrame) -> list[int]:
        """The least hash of each of ``documents`` residues: formed with partial sums, never more rows than that."""
        return [r.h for r in rows.groupBy(F.pmod("h", F.lit(sample.documents)).alias("part")).agg(F.min("h").alias("h")).collect()]

    wanted = set(few(texts.where(F.col("text").rlike(shaped)))) | set(few(texts))
    found = texts.where(F.col("h").isin(*wanted)).dropDuplicates(["h"]).collect() if wanted else []
    picked = [r.text for r in sorted(found, key=lambda r: r.h)]
    return trained(list(dict.fromkeys(picked)), sample)


def scan(texts: list[str], model: Model) -> list[list[tuple[int, int, str, float, bool]]]:
    """For each text its spans (start, end, kind, probability, confirmed): all base ones, confirmed others.

    A base span is confirmed unless the network is sure that it is harmless (``Model.clear``).
    """
    base = [base_spans(t) for t in texts]
    spans = [b + added_candidates(t, b) for t, b in zip(texts, base, strict=True)]
    findings = [(t[max(0, s - CONTEXT) : s], t[s:e], t[e : e + CONTEXT]) for t, own in zip(texts, spans, strict=True) for s, e, _ in own]
    scores, at, out = probabilities(model, findings).tolist(), 0, []
    for own, fixed in zip(spans, base, strict=True):
        limit = lambda k: model.clear if k in BASE_KINDS else model.threshold
        judged = [(s, e, k, p, p >= limit(k)) for (s, e, k), p in zip(own, scores[at : at + len(own)], strict=True)]
        at += len(own)
        kept = judged[: len(fixed)] + [j for j in judged[len(fixed) :] if j[4]]
        out.append(sorted(kept, key=lambda j: (j[0], _ORDER[j[2]])))
    return out


def _joined(spans) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per row: counts, digest and spans of secrets in the whole text.

    doc_id, n_assign, n_access, n_hex (base findings), base_sha256, spans (``kind:start:end`` in code
    points, by start, then kind; base spans and those that the network added), n_confirmed (base spans that
    the network can't clear, and added ones) and scores (array of double, in the order of spans). Without
    ``model`` one is fitted on ``docs``. A null text is empty; an empty text has no spans and the digest of the
    empty string. Null doc_ids and repeated rows stay. Columns other than doc_id and text are not read. An empty
    table gives an empty result.
    """
    model = model or fit(docs)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan([t or "" for t in batch.column("text").to_pylist()], model)
        base = [[s for s in own if s[2] in BASE_KINDS] for own in found]
        counts = [pa.array([sum(s[2] == k for s in own) for own in base], pa.int64()) for k in BASE_KINDS]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), *counts,
                pa.array([hashlib.sha256(_joined(own).encode()).hexdigest() for own in base]),
                pa.array([_joined(own) for own in found], pa.string()),
                pa.array([sum(s[4] for s in own) for own in found], pa.int64()),
                pa.array([[s[3] for s in own] for own in found], pa.list_(pa.float64())),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed", "scores"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(
        rows, over,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long, scores array<double>",
    )


def redacted(docs: DataFrame, model: Model | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every confirmed secret of ``text`` replaced by ``mark``, and n_chars counted anew if there.

    No base span stays that the network can't clear. All rows and columns stay, repeated rows and columns of
    any other name too; a null text stays null, an empty one empty. An empty table gives an empty result.
    Without ``model`` one is fitted on ``docs``.
    """
    model, names = model or fit(docs), docs.columns

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        out = []
        for text, spans in zip(texts, scan([t or "" for t in texts], model), strict=True):
            parts, at = [], 0
            for start, end, *_, confirmed in spans:
                if confirmed and end > at:
                    parts += [text[at : max(at, start)], mark]
                    at = end
            out.append("".join([*parts, text[at:]]) if parts else text)
        made = {n: batch.column(n) for n in names} | {"text": pa.array(out, pa.string())}
        if "n_chars" in names:
            made["n_chars"] = pa.array([None if t is None else len(t) for t in out], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([made[n] for n in names], names)

    return per_batch(docs, over, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def query(docs: DataFrame) -> DataFrame:
    """The rows of query op8."""
    return find_secrets(docs)
