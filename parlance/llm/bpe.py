"""Byte-level BPE encoding and decoding on padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import pieces
from parlance.llm.common import per_batch

#: Pieces that a worker remembers, some 100 MB; a full memory is emptied.
MEMORY = 500_000
#: Widths of the padded matrices. A piece beyond the last is merged with a heap, since rounds times
#: width would grow with the square of its length.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128)
_WIDTH_OF = [next(w for w in WIDTHS if n <= w) for n in range(WIDTHS[-1] + 1)]
_ROWS = 1 << 16
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Codec:
    """Encoder and decoder for a file of ``base64(token) rank`` lines; ids are the ranks."""

    def __init__(self, path: str) -> None:
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self._hash_pairs()

    def _hash_pairs(self) -> None:
        """Every pair of tokens whose bytes together are a token, in a table of four slots a bucket."""
        ranks, left, right, made = self.ranks, [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = ranks.get(token[:cut])
                b = ranks.get(token[cut:]) if a is not None else None
                if b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        key = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(key))))))
        while True:
            bucket = ((key * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
            if not len(key) or np.bincount(bucket).max() <= 4:
                break
            self.bits += 1
        order = np.argsort(bucket, kind="stable")
        slot = np.arange(len(key)) - np.searchsorted(bucket[order], bucket[order])
        self.keys = np.full((1 << self.bits, 4), 2**64 - 1, np.uint64)
        self.made = np.full((1 << self.bits, 4), _NONE, np.int32)
        self.keys[bucket[order], slot] = key[order]
        self.made[bucket[order], slot] = np.array(made, np.int32)[order]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, _NONE without one. Ids below 0 are padding."""
        key = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        bucket = ((key * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(key.shape, _NONE)
        for slot in range(4):
            out = np.where(self.keys[bucket, slot] == key, self.made[bucket, slot], out)
        return out

    def _matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        """Merge all rows in step: each round, every row's leftmost pair of least rank. Ids as bytes."""
        n = len(rows)
        lengths = np.fromiter(map(len, rows), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        at = np.arange(width) < lengths[:, None]
        ids[at] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        done, live = ids.copy(), np.arange(n)
        rank = np.full((n, width), _NONE)
        rank[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(live):
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(live)), best]
            over = low == _NONE
            if over.any():  # compaction: finished rows leave the matrix
                done[live[over]] = -1
                done[live[over], : ids.shape[1]] = ids[over]
                keep = ~over
                live, ids, rank, best, low = live[keep], ids[keep], rank[keep], best[keep], low[keep]
                if not len(live):
                    break
            r = np.arange(len(live))
            shift = np.arange(ids.shape[1] - 1) > best[:, None]
            ids[r, best] = low
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            for first in (best - 1, best):
                ok = (first >= 0) & (first + 1 < ids.shape[1])
                x, y = r[ok], first[ok]
                rank[x, y] = self.pair_ranks(ids[x, y], ids[x, y + 1])
            used = int((ids >= 0).sum(axis=1).max())
            if used < ids.shape[1]:
                ids, rank = ids[:, :used].copy(), rank[:, :used].copy()
        held = done >= 0
        ends = (4 * held.sum(axis=1).cumsum()).tolist()
        flat = done[held].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _heap(self, row: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap of (rank, place)."""
        ids = self.byte_id[np.frombuffer(row, np.uint8)].tolist()
        n, tokens, ranks = len(ids), self.tokens, self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def rank(i: int) -> int | None:
            j = after[i]
            return ranks.get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None

        heap = [(k, i) for i in range(n - 1) if (k := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            k, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != k:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = k, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p in (before[i], i):
                if p >= 0 and (x := rank(p)) is not None:
                    heapq.heappush(heap, (x, p))
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int32)

    def _learn(self, new: list[str]) -> None:
        by_width: dict[int, tuple[list[str], list[bytes]]] = {w: ([], []) for w in WIDTHS}
        ranks, known, longest = self.ranks, self.known, WIDTHS[-1]
        for p in new:
            raw = p.encode()
            if raw in ranks:
                known[p] = ranks[raw].to_bytes(4, "little")
            elif len(raw) > longest:
                known[p] = self._heap(raw).astype("<u4").tobytes()
            else:
                names, rows = by_width[_WIDTH_OF[len(raw)]]
                names.append(p)
                rows.append(raw)
        for width, (names, rows) in by_width.items():
            step = max(1, _ROWS * 8 // width)
            for at in range(0, len(names), step):
                known.update(zip(names[at : at + step], self._matrix(rows[at : at + step], width), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        if len(self.known) > MEMORY:
            self.known.clear()
        split = [pieces.split(t) for t in texts]
        self._learn(list({p for found in split for p in found if p not in self.known}))
        known = self.known
        return [b"".join(map(known.__getitem__, found)) for found in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids from ``encode`` stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` (binary).

    One row per row, repeated rows too; all columns stay, and columns of these three names, in capitals or
    not, are replaced. A null text counts as empty and has no ids. An empty table gives an empty result.
    ``vocabulary`` is a local path, the same on every executor.
    """
    kept = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens", "decoded")]

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary)
        ids = c.encode([t or "" for t in batch.column("text").to_pylist()])
        made = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
        made.append(pa.array([c.decode(x) for x in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(
            [batch.column(k) for k in kept] + made, [*kept, "ids", "n_tokens", "decoded"]
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select([f"`{c}`" for c in kept]).schema)
    return per_batch(docs.select([f"`{c}`" for c in kept]), over, f"{schema}, ids binary, n_tokens long, decoded binary")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each row; ids and bytes stay in the worker."""

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary)
        ids = c.encode([t or "" for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids]),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, over, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(docs: DataFrame) -> DataFrame:
    """The rows of query op6: digests through the same codec, so that the ids need not leave the worker."""
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
