"""Quality rules on repetition: characters inside duplicated n-grams and lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import per_batch

_BLANKS = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
_BASE = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Limits:
    """A text that exceeds one of these is not kept. Shares are of the characters in words."""

    #: Those of the MassiveText quality rules (Rae et al., 2021, table A1).
    duplicate_line_share: float = 0.30
    duplicate_line_chars: float = 0.20
    top_ngram: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    duplicate_ngram: tuple[tuple[int, float], ...] = (
        (5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10),
    )
    #: An extra beside the method: symbols to a word (the same rules have it for # and ellipses).
    symbols_per_word: float = 0.10
    #: The base rules, which the contract of query op5 fixes.
    min_words: int = 50
    repeat_word_share: float = 0.50


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words stand in a window of ``width`` that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _triples(ids: np.ndarray, distinct: int) -> np.ndarray:
    """An exact number for every three-word window: equal windows, equal numbers."""
    pair = ids[:-2] * distinct + ids[1:-1]
    if distinct >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    return pair * distinct + ids[2:]


def measure(text: str | None, limits: Limits = Limits()) -> tuple:
    """The measures of one text; see ``quality`` for their meaning."""
    text = text or ""
    words = text.encode().split()  # bytes.split cuts at exactly 0x20 and 0x09-0x0D
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, _SYMBOLS))
    seen: set[str] = set()
    lines = dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if bare := line.strip(_BLANKS):
            lines += 1
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(bare) - sum(map(bare.count, _BLANKS))
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeat_words = 0
    if n > 3:
        windows = _triples(ids, len(number))
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(counts[inverse] > 1)
        repeat_words = int(_covered(twice, 3, n).sum()) if len(twice) else 0
    base_failed = n < limits.min_words or repeat_words > limits.repeat_word_share * n
    worst_top = worst_dup = 0.0
    refused = []
    if dup_lines > limits.duplicate_line_share * lines:
        refused.append("lines")
    if dup_line_chars > limits.duplicate_line_chars * word_chars:
        refused.append("line_chars")
    if n > 2 and word_chars:
        sizes = np.array([len(w.decode()) if not w.isascii() else len(w) for w in number], np.int64)[ids]
        # One random-looking odd number for each distinct word; windows are hashed by rolling.
        seeds = (np.arange(1, len(number) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
        seeds = ((seeds ^ (seeds >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
        x, top, dup = seeds[ids], dict(limits.top_ngram), dict(limits.duplicate_ngram)
        rolled, length = x, np.concatenate([[0], np.cumsum(sizes)])
        for width in range(2, max([*top, *dup]) + 1):
            if n < width:
                break
            rolled = rolled[: n - width + 1] * _BASE + x[width - 1 :]
            if width not in top and width not in dup:
                continue
            order = np.argsort(rolled, kind="stable")
            ranked = rolled[order]
            same = ranked[1:] == ranked[:-1]
            if not same.any():
                break  # without a repeated window there is no longer one either
            if width in top:
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                counts = np.diff(np.append(first, len(ranked)))
                at = order[first]
                chars = (length[at + width] - length[at]) * counts * (counts > 1)
                share = min(1.0, float(chars.max()) / word_chars)
                worst_top = max(worst_top, share)
                if share > top[width]:
                    refused.append(f"top_{width}")
            if width in dup:
                share = float(sizes[_covered(order[1:][same], width, n)].sum()) / word_chars
                worst_dup = max(worst_dup, share)
                if share > dup[width]:
                    refused.append(f"ngram_{width}")
    if symbols > limits.symbols_per_word * n:
        refused.append("symbols")
    return (
        n, word_chars, symbols, dup_lines, repeat_words, base_failed, not base_failed and not refused,
        dup_line_chars / max(word_chars, 1), worst_top, worst_dup, ",".join(refused),
    )


_COLUMNS = (
    ("n_words", pa.int64(), "long"), ("word_chars", pa.int64(), "long"), ("n_symbols", pa.int64(), "long"),
    ("n_dup_lines", pa.int64(), "long"), ("n_repeat_words", pa.int64(), "long"),
    ("base_failed", pa.bool_(), "boolean"), ("kept", pa.bool_(), "boolean"),
    ("dup_line_share", pa.float64(), "double"), ("top_ngram_share", pa.float64(), "double"),
    ("dup_ngram_share", pa.float64(), "double"), ("refused", pa.string(), "string"),
)


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per row with the measures of its whole text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal
    an earlier line), n_repeat_words (words in three-word windows found twice or more), base_failed;
    dup_line_share (characters of repeated lines), top_ngram_share (largest share of one repeated n-gram,
    all its occurrences, n = 2-4), dup_ngram_share (largest share of characters in n-grams that occurred
    before, n = 5-10); refused: the measures beyond ``limits``, comma-joined; kept: base_failed is false and
    refused is empty. A null text has no words, so it fails. Null doc_ids and repeated rows stay. Columns
    other than doc_id and text are not read. An empty table gives an empty result.
    """

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(zip(*(measure(t, limits) for t in batch.column("text").to_pylist())))
        made = [pa.array(v, kind) for v, (_, kind, _) in zip(found, _COLUMNS, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *(c[0] for c in _COLUMNS)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, over, "doc_id long, " + ", ".join(f"{n} {t}" for n, _, t in _COLUMNS))


def query(docs: DataFrame) -> DataFrame:
    """The rows of query op5."""
    return quality(docs)
