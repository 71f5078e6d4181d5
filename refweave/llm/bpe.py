"""Byte-level BPE: texts to token ids and back.

Texts are cut by a pattern; the distinct pieces of an Arrow batch are laid out as
padded matrices, one per length bucket.  In each round every row merges its leftmost
pair of lowest rank: ranks of pairs come from a hash table in numpy arrays, the
column behind the merged pair closes up, and finished rows leave the matrix.  Pieces
beyond ``LONG_PIECE`` bytes (a text without blanks, say) would need as many rounds as
they have bytes, so those take the same merges through a heap.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from refweave.llm.common import Remembered, bounded_batches, text_of, tidy

LONG_PIECE = 256
_WIDTHS = np.array([2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, LONG_PIECE])
_CELLS = 1 << 20  # of one matrix
_NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_PAD = np.int64(-1)


class PairTable:
    """Open addressing: (left id, right id) to the id of the merged token, which is its rank."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - int(len(keys) * 4 + 16).bit_length())
        size = 1 << (64 - int(self.shift))
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, _EMPTY)
        self.values = np.full(size, _NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = todo[self.keys[at[todo]] == _EMPTY]
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots] = keys[free[first]]
            self.values[slots] = values[free[first]]
            todo = np.setdiff1d(todo, free[first], assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``_NONE`` if it does not merge or is padding."""
        keys = ((left << 32) | (right & 0xFFFFFFFF)).astype(np.uint64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        miss = np.nonzero((found != keys) & (found != _EMPTY))
        while len(miss[0]):
            at[miss] = (at[miss] + 1) & self.mask
            found = self.keys[at[miss]]
            hit = found == keys[miss]
            out[tuple(x[hit] for x in miss)] = self.values[at[miss]][hit]
            more = ~hit & (found != _EMPTY)
            miss = tuple(x[more] for x in miss)
        return out


class Vocabulary:
    """The ranks of one file (lines of base64 token and rank), with the pairs that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, n in self.ids.items():
            self.tokens[n] = token
        pairs: dict[int, int] = {}
        for token, n in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = n
        self.pairs = pairs
        self.table = PairTable(
            np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        )
        self.byte_ids = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        rest = []
        for n, piece in enumerate(pieces):
            known = self.ids.get(piece)
            if known is not None:
                out[n] = known.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[n] = self._merge_long(piece)
            else:
                rest.append(n)
        rest = np.array(rest, np.int64)
        bucket = np.searchsorted(_WIDTHS, lengths[rest]) if len(rest) else rest
        for b in np.unique(bucket):
            width, rows = int(_WIDTHS[b]), rest[bucket == b]
            for start in range(0, len(rows), _CELLS // width):
                some = rows[start : start + _CELLS // width]
                for n, ids in zip(some, self._merge([pieces[n] for n in some], lengths[some], width), strict=True):
                    out[n] = ids
        return out

    def _merge(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        inside = np.arange(width) < lengths[:, None]
        ids = np.where(inside, self.byte_ids[raw], _PAD)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        rows, done = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            best = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            rank = ranks[every, best]
            going = rank != _NONE
            if not going.all():  # compaction: finished rows leave
                for n, row in zip(rows[~going], ids[~going], strict=True):
                    done[n] = row[row != _PAD].astype("<u4").tobytes()
                rows, ids, ranks, best, rank = rows[going], ids[going], ranks[going], best[going], rank[going]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            ids[every, best] = rank
            columns = np.arange(ids.shape[1] - 1)
            ids = np.concatenate(
                [np.take_along_axis(ids, columns + (columns > best[:, None]), 1), np.full((len(rows), 1), _PAD)], 1
            )
            columns = columns[:-1]
            ranks = np.concatenate(
                [np.take_along_axis(ranks, columns + (columns >= best[:, None]), 1), np.full((len(rows), 1), _NONE)], 1
            )
            ranks[every, best] = self._ranks(ids[every, best], ids[every, best + 1])
            before = np.flatnonzero(best > 0)
            at = best[before]
            ranks[before, at - 1] = self._ranks(ids[before, at - 1], ids[before, at])
            left = int((ids != _PAD).sum(axis=1).max())
            if left < ids.shape[1]:
                ids, ranks = ids[:, : max(2, left)], ranks[:, : max(1, left - 1)]
        return done

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where((left < 0) | (right < 0), _NONE, self.table.rank(left, right))

    def _merge_long(self, piece: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (r, i) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (r := self.pairs.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        kept = np.array(ids, np.int64)
        return kept[kept >= 0].astype("<u4").tobytes()


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def encode_texts(texts: Iterable[str | None], path: str, pattern: str, known: Remembered | None = None) -> list[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit integers; ``known`` are pieces from before."""
    vocab, find, known = vocabulary(path), _pattern(pattern).findall, Remembered() if known is None else known
    split = [find(t) if t else [] for t in texts]
    new = known.missing(set().union(*split))
    known.learn(new, vocab.encode_pieces([p.encode() for p in new]))
    return [b"".join([known[p] for p in pieces]) for pieces in split]


def encode(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """``(key, n_tokens, ids)`` for each row of ``df``; other columns are not carried.

    ``ids`` is binary: little-endian unsigned 32-bit integers.  Null and empty texts
    give no ids.  Rows are independent, so repeated rows stay repeated; a null key
    stays null.  An empty table gives an empty table.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered()
        for batch in batches:
            ids = encode_texts(batch.column(1).to_pylist(), path, pattern, known)
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), counts, pa.array(ids, pa.binary())], names=[key, "n_tokens", "ids"]
            )

    source = df.select(F.col(key), text_of(text).alias("_text"))
    return source.mapInArrow(run, f"`{key}` {kind.simpleString()}, n_tokens bigint, ids binary")


def decode(df: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes that the ids of column ``ids`` stand for; null ids: none."""
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != "decoded"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for batch in batches:
            made = [
                b"".join([tokens[n] for n in np.frombuffer(x or b"", "<u4").tolist()])
                for x in batch.column(kept.index("ids")).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*kept, "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema]
    return df.select(*kept).mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def digests(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and reduce both to digests: ``(key, n_tokens, ids_sha256, decoded_sha256)``."""
    return decode(encode(df, key, text, path, pattern), path).select(
        key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
