"""Byte-level BPE over padded matrices, and back.

The distinct pieces of a batch are put into matrices of similar length, one
piece a row, padded on the right. Each round every row merges its leftmost
pair of least rank: the ranks of all adjacent pairs lie in a second matrix,
filled from a hash table, so a round is one argmin, one write and one gather
that closes the gaps. A round takes one column off every row that goes on,
and rows without a pair left are taken out, so the matrices shrink. A very long
piece is a row of its own and takes all places of its least pair in one round,
up to the first whose merge makes a lesser pair.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatebed.llm.common import text_or_empty

#: Cells of one matrix. Rows are taken up to it, so memory is bounded.
CELLS = 1 << 20
#: Longer pieces are matrices of one row, which merges its least pair wherever
#: it stands in one round, in the order of single merges.
LONG_PIECE = 512
#: Pieces whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 300_000
#: Code points of text whose pieces are held at once.
RUN_CHARS = 1 << 20
_NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Open addressing from (left id, right id) to the id of the merged token."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        left, right = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
        keys, values = (left << np.uint64(32)) | right, np.array(list(pairs.values()), np.int32)
        slots = ((keys * _ODD) >> self.shift).astype(np.int64)
        while len(keys):
            free = self.keys[slots] == _EMPTY
            first = np.zeros(len(keys), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + ~free[~put]) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, _NONE where the pair is unknown or an end is padding (-1)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.size, _NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[at].astype(np.uint64) << np.uint64(32)) | right[at].astype(np.uint64)
        slots = ((keys * _ODD) >> self.shift).astype(np.int64)
        while len(at):
            seen = self.keys[slots]
            hit = seen == keys
            out[at[hit]] = self.values[slots[hit]]
            go = ~hit & (seen != _EMPTY)
            at, keys, slots = at[go], keys[go], (slots[go] + 1) & self.mask
        return out.reshape(shape)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {
            (ranks[token[:i]], ranks[token[i:]]): rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.merged = PairTable(pairs)
        self.known: dict[str, bytes] = {}

    # -- pieces to ids

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: its own rank if it has one, else by merging."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = np.array([rank], np.int32)
            elif len(piece) > LONG_PIECE:
                out[i] = self._merge_long(piece)
            else:
                rest.append(i)
        rest.sort(key=lambda i: len(pieces[i]))
        at = 0
        while at < len(rest):
            width = len(pieces[rest[at]])
            top = max(8, width + width // 4)  # a bucket of similar lengths
            end = at
            while end < len(rest) and len(pieces[rest[end]]) <= top and (end - at + 1) * top <= CELLS:
                end += 1
            end = max(end, at + 1)
            for i, ids in zip(rest[at:end], self._merge_rows([pieces[i] for i in rest[at:end]])):
                out[i] = ids
            at = end
        return out

    def _merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(sizes.max())
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = self.merged(ids[:, :-1], ids[:, 1:])
        row_of = np.arange(len(rows))
        out: list[np.ndarray] = [None] * len(rows)  # type: ignore[list-item]
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            rank = ranks[np.arange(len(ids)), best] if ranks.shape[1] else np.full(len(ids), _NONE)
            goes = rank != _NONE
            for i in np.flatnonzero(~goes):
                out[row_of[i]] = ids[i][ids[i] >= 0]
            if not goes.any():
                return out
            if not goes.all():
                ids, ranks, best, rank, row_of = ids[goes], ranks[goes], best[goes], rank[goes], row_of[goes]
            here = np.arange(len(ids))
            ids[here, best] = rank
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), axis=1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= best[:, None]), axis=1)
            left = best > 0
            ranks[here[left], best[left] - 1] = self.merged(ids[here[left], best[left] - 1], ids[here[left], best[left]])
            right = best < ids.shape[1] - 1
            ranks[here[right], best[right]] = self.merged(ids[here[right], best[right]], ids[here[right], best[right] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """A matrix of one row: each round merges the least pair in all places that single rounds would take in a row.

        Rounds are as many as the piece has kinds of merges, not as many as it
        has bytes. A merge may make a pair of lesser rank with a neighbour, which
        single rounds would take next, so a round ends with the first such one.
        """
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.merged(ids[:-1], ids[1:])
        while len(ranks) and (rank := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == rank)
            # of places in a row, which overlap, the first, third and so on
            run = np.concatenate(([0], np.flatnonzero(np.diff(at) > 1) + 1))
            in_run = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[in_run % 2 == 0]
            new = np.full(len(at), rank, np.int32)
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            joined = np.concatenate(([False], np.diff(at) == 2))  # the place before has just been merged
            before = np.where(joined, rank, np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)).astype(np.int32)
            lesser = np.minimum(self.merged(before, new), self.merged(new, after)) < rank
            at = at[: int(np.argmax(lesser)) + 1] if lesser.any() else at
            ids[at] = rank
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            ranks = ranks[np.delete(keep, -1)] if keep[-1] else ranks[keep[:-1]][:-1]
            here = np.flatnonzero(keep)
            at = np.searchsorted(here, at)
            for side in (at - 1, at):
                side = side[(side >= 0) & (side < len(ids) - 1)]
                ranks[side] = self.merged(ids[side], ids[side + 1])
        return ids

    # -- texts to ids and back

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        for piece, ids in zip(new, self.encode_pieces([p.encode() for p in new])):
            self.known[piece] = ids.astype("<u4").tobytes()

    def runs(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, a bounded number at a time."""
        if len(text) <= RUN_CHARS:
            yield self.split.findall(text)
            return
        matches = self.split.finditer(text)
        while run := [m[0] for m in islice(matches, RUN_CHARS // 8)]:
            yield run

    def encode_runs(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(index of the text, ids as little-endian 32-bit) in order; a long text has several."""
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for run in self.runs(text):
                held.append((i, run))
                size += len(run)
                if size >= RUN_CHARS // 8:
                    yield from self._encode_held(held)
                    held, size = [], 0
        yield from self._encode_held(held)

    def _encode_held(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn(set().union(*(run for _, run in held)))
        known = self.known
        for i, run in held:
            yield i, b"".join([known[p] for p in run])

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


_BUILT: dict[tuple[int, str], ByteBpe] = {}


def _built(ranks: dict[bytes, int], pattern: str) -> ByteBpe:
    key = (hash(frozenset(ranks.items())), pattern)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ByteBpe(ranks, pattern)
    return _BUILT[key]


def bpe_tokens(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Each row with ``n_tokens, ids_sha256, decoded_sha256`` in place of its text.

    With ``with_ids`` the ids come too, as an array. Null and empty texts have
    no tokens. The rank file has a fixed size and is broadcast. Other columns
    are dropped but doc_id; rows that repeat are each encoded.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _built(shipped.value, pattern)
        for batch in batches:
            n = batch.num_rows
            counts, all_ids = [0] * n, [[] for _ in range(n)]
            sums = [(hashlib.sha256(), hashlib.sha256()) for _ in range(n)]
            for i, ids in bpe.encode_runs(batch.column(1).to_pylist()):
                counts[i] += len(ids) // 4
                sums[i][0].update(ids)
                sums[i][1].update(bpe.decode(ids))
                if with_ids:
                    all_ids[i].append(np.frombuffer(ids, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), *(pa.array([s[k].hexdigest() for s in sums]) for k in (0, 1))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([np.concatenate(x) if x else np.zeros(0, np.int32) for x in all_ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)


def op1_byte_bpe(docs: DataFrame) -> DataFrame:
    """The contract's columns with the public 50k byte-level vocabulary."""
    import public_tokenizers

    return bpe_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
