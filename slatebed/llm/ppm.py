"""Scores of a byte model: prediction by partial matching.

The model is a trie of contexts of up to ``ORDER`` bytes with the counts of
what followed them in all training texts. A byte is looked for in the longest
context; where it has not followed, an escape is paid (method C: as likely as
there are different successors) and the next shorter context is asked, without
the successors that the longer one has already ruled out. The last resort is
equal chances for what no context has ruled out.

Every count of the training texts is kept, however large they are, so the model
is never gathered in one place. It is cut into parts by the ``NEAR`` bytes next
to the symbol; a part holds all that longer contexts with these bytes have. The
chance of a byte depends on its code alone (itself and the ORDER bytes before
it). Texts are laid in chunks; the distinct codes of a chunk, with their counts
where it is learned from, are sorted once, sent to their parts to make the
model, and sent there again for their chances, which come back to the chunk in
the order of its codes. Only contexts of fewer than ``NEAR`` bytes are
broadcast: 257**NEAR entries at most, whatever the corpus.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatebed.llm.common import forget, stored, text_or_empty
from slatebed.llm.toxicity import fold

ORDER = 6
#: Context bytes that name a part; shorter contexts are broadcast.
NEAR = 3
#: Bytes of text for each part of the model.
PART = 1 << 24
#: Bytes of text of a chunk. Longer texts are cut at white space into pieces.
LAID = 1 << 24
#: Logarithms of chances are handed on as whole multiples of this: 1.2e-10 off at most.
UNIT = 2.0**-32
#: Texts are kept once and shuffled once, so their chunks are compressed well.
TEXT_LEVEL = 7
#: Distinct n-grams that a task holds before it merges them, and rows of word counts.
DISTINCT, WORD_ROWS = 1 << 20, 1 << 20
#: Words with at least this share of the training tokens are looked up in a
#: broadcast table of at most 1 / HOT entries, all others by a join.
HOT = 2.0**-19
#: Bytes that UTF-8 never has: before the start and after the end of a text.
START, END = 0xFE, 0xFF
SYMBOLS = 257
#: Codes scored at a time, and rows of a batch.
STEP, SLICE = 1 << 18, 1000
#: Ranges of codes of a chunk that are counted one after the other.
RANGES = 4
#: Packed rows that are handed to Spark at a time.
ROWS = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END_WORD = " end"  # has a space, so no word is this one
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CODE = np.uint64((1 << (8 * (ORDER + 1))) - 1)
_CONTEXT = np.uint64((1 << (8 * ORDER)) - 1)
_HEAD = bytes([START]) * ORDER
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def _codes(texts: list[bytes], heads: list[bytes] | None = None, last: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all bytes and ends of the texts, and where each text's codes start.

    A code has the byte itself in its lowest byte and the ORDER bytes before it
    above, nearest first, so a context of order k is the code without its higher
    bytes. A piece of a text has a ``head``, the bytes before it, and an end only
    if it is the ``last``.
    """
    heads, last = heads or [_HEAD] * len(texts), last or [True] * len(texts)
    end = bytes([END])
    data = b"\0" * (7 - ORDER) + b"".join(x for h, t, z in zip(heads, texts, last) for x in (h, t, end if z else b""))
    sizes = np.array([len(t) + z for t, z in zip(texts, last)], np.int64)
    # eight bytes up to each byte, read as one number
    codes = np.ndarray(max(0, len(data) - 7), ">u8", data, strides=(1,)).astype(np.uint64) if len(data) > 7 else np.zeros(0, np.uint64)
    codes &= _CODE
    own = np.ones(len(codes) + ORDER, bool)
    first = np.cumsum(sizes + ORDER) - sizes - ORDER
    for k in range(ORDER):
        own[first + k] = False
    return codes[own[ORDER:]], np.cumsum(sizes) - sizes


def _turned(codes: np.ndarray) -> np.ndarray:
    """Codes with their context bytes in the other order, so that the nearest leads; and back.

    In order, such codes have contexts that are alike next to each other.
    """
    return (((codes.byteswap() >> np.uint64(8)) & _CONTEXT) << np.uint64(8)) | (codes & np.uint64(255))


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turned codes in order, each once, and how often each came, as 32 bits.

    The argument is sorted in place and overwritten by its distinct codes, a
    stretch at a time, so nothing else of its length is held beside it.
    """
    codes.sort()
    kept, firsts = 0, [np.zeros(0, np.int32)]
    before = None
    for at in range(0, len(codes), STEP):
        some = codes[at : at + STEP]
        new = np.empty(len(some), bool)
        new[0] = before is None or some[0] != before
        np.not_equal(some[1:], some[:-1], out=new[1:])
        before = some[-1]
        found = some[new]
        codes[kept : kept + len(found)] = found
        kept += len(found)
        firsts.append(np.flatnonzero(new).astype(np.int32) + np.int32(at))
    first = np.concatenate([*firsts, np.array([len(codes)], np.int32)])
    return codes[:kept].copy(), np.diff(first)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


class _Bag:
    """Distinct codes and how often they came, merged as they grow."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, codes: np.ndarray, n: np.ndarray) -> None:
        self.held.append((codes, n))
        self.size += len(codes)
        if self.size > 2 * DISTINCT:
            self.held = [self.merged()]
            self.size = len(self.held[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        codes, n = (np.concatenate([pair[i] for pair in self.held]) for i in (0, 1))
        self.held.clear()  # before the sort, which needs as much again
        self.size = 0
        return _summed(codes, n, "stable")  # which makes use of sorted stretches


def _summed(codes: np.ndarray, n: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, n
    order = np.argsort(codes, kind=kind)
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(n, first, dtype=np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by planes of like bytes, compressed; in front how many bytes a number has, and their length."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + planes.nbytes.to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = _inflated(data[1:]).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(kind).ravel()


def _pack_sorted(codes: np.ndarray) -> bytes:
    return _pack(np.diff(codes, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _inflated(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)


def _part(codes: np.ndarray, bits: int) -> np.ndarray:
    """The part of the model that knows each turned code."""
    near = codes >> np.uint64(8 * (ORDER + 1 - NEAR))
    return ((near * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int32)


def _parts(codes: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts and the places of their codes; sorted codes stay sorted."""
    part = _part(codes, bits)
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else []
    for i, j in zip(edges[:-1], edges[1:]):
        yield int(part[i]), order[i:j]


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = ROWS) -> Iterator[pa.RecordBatch]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


_ASKED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("wanted", pa.bool_()), ("codes", pa.binary()), ("times", pa.binary()), ("word", pa.string()), ("n", pa.int64())])
_ASKED_DDL = "part int, chunk long, wanted boolean, codes binary, times binary, word string, n long"
_COUNTS = pa.schema([("part", pa.int32()), ("codes", pa.binary()), ("times", pa.binary()), ("low", pa.int64()), ("n", pa.int64())])
_COUNTS_DDL = "part int, codes binary, times binary, low long, n long"
_LISTS = (("uids", pa.int64()), ("ids", pa.int64()), ("sizes", pa.int32()), ("heads", pa.binary()), ("last", pa.bool_()))
_LAID = pa.schema([("chunk", pa.int64()), ("learn", pa.bool_()), ("wanted", pa.bool_()), *((n, pa.list_(t)) for n, t in _LISTS), ("texts", pa.binary())])
_LAID_DDL = "chunk long, learn boolean, wanted boolean, uids array<long>, ids array<long>, sizes array<int>, heads array<binary>, last array<boolean>, texts binary"
_ANSWERS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("logs", pa.binary())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _pieces(text: str) -> Iterator[tuple[str, bytes, bool]]:
    """A text, or a long one in pieces that end where white space begins: text, the bytes before it, whether it is the last."""
    at, head = 0, _HEAD
    while True:
        end = at + LAID
        if end < len(text):
            blank = _BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        piece = text[at:end]
        yield piece, head, end >= len(text)
        if end >= len(text):
            return
        at, head = end, (head + piece[-ORDER:].encode().translate(_LOWER))[-ORDER:]


def _lay_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-cased texts in chunks, a row each; those of a chunk are all learned from or none, all wanted or none."""

    def row(chunk: int, kind: tuple[bool, bool], pieces: list[tuple]) -> tuple:
        *about, texts = zip(*pieces)
        uids, ids, heads, last = map(list, about)
        body = b"".join(texts)
        packed = len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=TEXT_LEVEL).compress(body, asbytes=True)
        return chunk, *kind, uids, ids, [len(t) for t in texts], heads, last, packed

    def laid() -> Iterator[tuple]:
        chunk = TaskContext.get().partitionId() << 32
        held: dict[tuple[bool, bool], list] = {}
        size: dict[tuple[bool, bool], int] = {}
        for batch in _sliced(batches):
            for uid, doc_id, text, learn, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                for piece, head, last in _pieces(text):
                    kind, low = (learn, wanted), piece.encode().translate(_LOWER)
                    held.setdefault(kind, []).append((uid, doc_id, head, last, low))
                    size[kind] = size.get(kind, 0) + len(low)
                    if size[kind] >= LAID:
                        yield row(chunk, kind, held.pop(kind))
                        chunk, size[kind] = chunk + 1, 0
        for kind, pieces in held.items():
            yield row(chunk, kind, pieces)
            chunk += 1

    yield from _batches(laid(), _LAID, 1)


class _Chunk:
    """The texts of a chunk, as one stretch of bytes and where they are in it."""

    def __init__(self, row: dict):
        self.row = row
        self.data = _inflated(row["texts"])
        self.offsets = np.concatenate(([0], np.cumsum(row["sizes"]))).astype(np.int32)

    def stretches(self, size: int) -> Iterator[tuple[int, int]]:
        """Ranges of texts of about so many bytes."""
        n, at = len(self.offsets) - 1, 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + size, side="right")) - 1)
            yield at, min(n, end)
            at = min(n, end)

    def codes(self, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Turned codes of the texts from ``at`` to ``end`` and where each text's start."""
        cuts = self.offsets[at : end + 1].tolist()
        texts = [self.data[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
        codes, starts = _codes(texts, self.row["heads"][at:end], self.row["last"][at:end])
        return _turned(codes), starts

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes in order and how often each came, as 32 bits.

        They are counted a range of codes at a time; each time the codes are
        made anew, which takes less memory than to hold all of them.
        """
        found = []
        for low, high in zip(bounds := self._bounds(), bounds[1:]):
            held = []
            for at, end in self.stretches(STEP):
                codes, _ = self.codes(at, end)
                held.append(codes[(codes >= low) & (codes < high)])
            found.append(_distinct(np.concatenate(held) if held else np.zeros(0, np.uint64)))
        return tuple(np.concatenate([pair[i] for pair in found]) for i in (0, 1))

    def _bounds(self) -> list[np.uint64]:
        """Ends of ranges that have about as many codes each, by those of the first texts."""
        at, end = next(self.stretches(STEP), (0, 0))
        some = np.sort(self.codes(at, end)[0])
        inner = [some[len(some) * k // RANGES] for k in range(1, RANGES)] if len(some) else []
        return [np.uint64(0), *inner, np.uint64(1 << 63)]  # codes have ORDER + 1 bytes

    def words(self, at: int, end: int) -> pa.ListArray:
        """Words of each text, with an empty one where white space starts or ends it."""
        texts = pa.StringArray.from_buffers(len(self.offsets) - 1, pa.py_buffer(self.offsets), pa.py_buffer(self.data))
        return pc.ascii_split_whitespace(texts.slice(at, end - at))


def _ask_batches(bits: int):
    """The distinct codes of each chunk by part, counted where it is learned from, and counts of words, whose part is null."""

    def asked(chunk: _Chunk) -> Iterator[tuple]:
        row = chunk.row
        codes, times = chunk.counted()
        for part, at in _parts(codes, bits):
            yield part, row["chunk"], row["wanted"], _pack_sorted(codes[at]), _pack(times[at].astype(np.int64)) if row["learn"] else None, None, None

    def counted(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def emitted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.to_batches(1 << 16):
            columns = {f.name: pa.nulls(batch.num_rows, f.type) for f in _ASKED}
            columns |= {"word": batch.column("word"), "n": batch.column("n")}
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for row in _rows(batches):
            chunk = _Chunk(row)
            yield from _batches(asked(chunk), _ASKED)
            pa.default_memory_pool().release_unused()
            if not row["learn"]:
                continue
            for at, end in chunk.stretches(16 * STEP):
                found = pc.value_counts(chunk.words(at, end).flatten())
                words, n = found.field("values"), found.field("counts")
                some = pc.not_equal(words, "")
                held.append(pa.table({"word": words.filter(some), "n": n.filter(some).cast(pa.int64())}))
            held.append(pa.table({"word": [_END_WORD], "n": pa.array([sum(row["last"])], pa.int64())}))
            if sum(t.num_rows for t in held) > 2 * WORD_ROWS:
                held = [counted(held)]
                if held[0].num_rows > WORD_ROWS:
                    yield from emitted(held.pop())
        if held:
            yield from emitted(counted(held))

    return run


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of counts a part, and its counts for shorter contexts; rows are sorted by part."""
    mask = np.uint64((1 << (8 * NEAR)) - 1)

    def done(part: int, bag: _Bag) -> Iterator[pa.RecordBatch]:
        codes, n = bag.merged()
        yield from _batches(iter([(part, _pack_sorted(codes), _pack(n.astype(np.int64)), None, None)]), _COUNTS)
        low, sums = _summed(_turned(codes) & mask, n)
        arrays = {f.name: pa.nulls(len(low), f.type) for f in _COUNTS} | {"low": pa.array(low.astype(np.int64)), "n": pa.array(sums.astype(np.int64))}
        yield pa.RecordBatch.from_arrays(list(arrays.values()), schema=_COUNTS)

    now, bag = None, _Bag()
    for row in _rows(batches):
        if row["part"] != now and now is not None:
            yield from done(now, bag)
        now = row["part"]
        bag.add(_unpack_sorted(row["codes"]), _unpack(row["times"], np.int64))
    if now is not None:
        yield from done(now, bag)


class Hashed:
    """Open addressing from unsigned 64-bit codes to their position in a list."""

    def __init__(self, codes: np.ndarray):
        bits = max(4, (3 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.codes = codes
        self.at = np.full(1 << bits, -1, np.int32)
        rest = np.arange(len(codes))
        slot = ((codes * _MULTIPLIER) >> self.shift).astype(np.int64)
        while len(rest):
            free = self.at[slot] < 0
            first = np.zeros(len(rest), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.at[slot[put]] = rest[put]
            rest, slot = rest[~put], (slot[~put] + ~free[~put]) & self.mask

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Positions, -1 where a code is not in the list."""
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        slot = ((codes * _MULTIPLIER) >> self.shift).astype(np.int64)
        found = self.at[slot]
        wrong = np.flatnonzero((found >= 0) & (self.codes[found] != codes))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & self.mask
            found[wrong] = self.at[slot]
            miss = (found[wrong] >= 0) & (self.codes[found[wrong]] != codes[wrong])
            wrong, slot = wrong[miss], slot[miss]
        return found


class Ppm:
    """``entries[k]``: codes of k context bytes and a symbol, their counts, contexts, their counts.

    With a model of shorter contexts ``below``, entries are those of the orders above.
    """

    LISTS = "counts", "grams", "log_count", "contexts", "total", "kinds", "dropped", "rest_total", "rest_kinds"

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], below: Ppm | None = None):
        for name in self.LISTS:
            setattr(self, name, list(getattr(below, name)) if below else [])
        for k, (codes, counts, seen, seen_counts) in enumerate(entries, len(self.grams)):
            self.counts.append(counts)
            self.grams.append(Hashed(codes))
            self.log_count.append(np.log10(counts))
            contexts, of = np.unique(codes >> np.uint64(8), return_inverse=True)
            self.contexts.append(Hashed(contexts))
            total = seen_counts[np.searchsorted(seen, contexts)] if len(contexts) else np.zeros(0)
            self.total.append(total)
            # what followed too rarely to be kept is known to have been something else
            self.dropped.append(total - np.bincount(of, counts, len(contexts)))
            self.kinds.append(np.bincount(of, minlength=len(contexts)).astype(float))
            if k:  # what the next shorter context has left when these successors are ruled out
                shorter = self.grams[k - 1](codes & np.uint64((1 << (8 * k)) - 1))
                gone = np.bincount(of, np.where(shorter >= 0, self.counts[k - 1][shorter], 0.0) if len(self.counts[k - 1]) else np.zeros(len(codes)), len(contexts))
                gone_kinds = np.bincount(of, shorter >= 0, len(contexts))
                node = self.contexts[k - 1](contexts & np.uint64((1 << (8 * (k - 1))) - 1))
                self.rest_total.append(np.where(node >= 0, self.total[k - 1][node], 0.0) - gone)
                self.rest_kinds.append(np.where(node >= 0, self.kinds[k - 1][node], 0.0) - gone_kinds)
            else:  # below order 0: symbols that no text has had
                self.rest_total.append(np.zeros(len(contexts)))
                self.rest_kinds.append(SYMBOLS - self.kinds[0])

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the chance of each code's symbol after its context."""
        out = np.zeros(len(codes))
        at = np.arange(len(codes))
        # what the context asked now has left, where a longer one has ruled out symbols; nan: none has
        total = np.full(len(codes), np.nan)
        kinds = np.full(len(codes), np.nan)
        for k in range(len(self.grams) - 1, -1, -1):
            if not len(self.total[k]):
                continue
            some = codes[at] & np.uint64((1 << (8 * (k + 1))) - 1)
            node = self.contexts[k](some >> np.uint64(8))
            entry = self.grams[k](some)
            there = node >= 0
            fresh = np.isnan(total)
            t = np.where(fresh, self.total[k][node], total)
            q = np.where(fresh, self.kinds[k][node], kinds)
            hit = entry >= 0
            out[at[hit]] += self.log_count[k][entry[hit]] - np.log10((t + q)[hit])
            # a context whose successors are all ruled out is left at no cost
            paid = ~hit & there & (t + q > 0.5)
            out[at[paid]] += np.log10(((self.dropped[k][node] + q) / np.maximum(t + q, 1))[paid])
            left = np.flatnonzero(~hit)
            total = np.where(there, self.rest_total[k][node], total)[left]
            kinds = np.where(there, self.rest_kinds[k][node], kinds)[left]
            at = at[left]
        remain = np.where(np.isnan(kinds), SYMBOLS, kinds)
        out[at] -= np.log10(np.maximum(remain, 1.0))
        return out


#: What a worker has made last, by its name.
_MADE: dict[str, object] = {}


def _made(name: str, make):
    """What ``make`` returns, made once by each worker."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = make()
    return _MADE[name]


def orders(codes: np.ndarray, n: np.ndarray, lowest: int, highest: int) -> list[tuple[np.ndarray, ...]]:
    """Counts of codes of the highest order to what :class:`Ppm` takes, every count kept."""
    entries: list[tuple[np.ndarray, ...]] = []
    for k in range(highest, lowest - 1, -1):
        codes, n = _summed(codes & np.uint64((1 << (8 * (k + 1))) - 1), n)
        contexts, sums = _summed(codes >> np.uint64(8), n)
        entries.insert(0, (codes, n.astype(np.float64), contexts, sums.astype(np.float64)))
    return entries


def _answer_batches(name: str, shipped: Broadcast):
    """Log chances of each chunk's codes by the part of the model before them in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = _made(name, lambda: Ppm(orders(*shipped.value, 0, NEAR - 1)))

        def answers() -> Iterator[tuple]:
            now, model = None, low
            for row in _rows(batches):
                if row["part"] != now:
                    now, model = row["part"], low
                codes = _turned(_unpack_sorted(row["codes"]))
                if row["chunk"] is None:
                    model = Ppm(orders(codes, _unpack(row["times"], np.int64), NEAR, ORDER), low)
                    continue
                logs = np.concatenate([model.log10(codes[i : i + STEP]) for i in range(0, len(codes), STEP)])
                yield row["chunk"], now, _pack(np.rint(logs / -UNIT).astype(np.int64))

        yield from _batches(answers(), _ANSWERS)

    return run


def _chunk_scores(chunk: _Chunk, logs: list[bytes], bits: int) -> np.ndarray:
    """log10 of the chance of each text of a chunk, from the packed answers to its codes by part."""
    n = len(chunk.row["ids"])
    every, _ = chunk.counted()
    answers = np.empty(len(every))
    for (_, at), packed in zip(_parts(every, bits), logs, strict=True):
        answers[at] = _unpack(packed, np.int64) * -UNIT
    scores = np.zeros(n)
    for at in range(0, n, 256):  # a text's number has a byte beside its code, so both are sorted at once
        end = min(at + 256, n)
        codes, starts = chunk.codes(at, end)
        text = np.repeat(np.arange(end - at, dtype=np.uint64), np.diff(np.append(starts, len(codes))))
        keys = np.sort((codes << np.uint64(8)) | text)
        code = keys >> np.uint64(8)
        first = np.concatenate(([True], code[1:] != code[:-1]))
        found = answers[np.searchsorted(every, code[first])]
        scores[at:end] = np.bincount((keys & np.uint64(255)).astype(np.int64), found[np.cumsum(first) - 1], end - at)
    return scores


def _word_sums(chunk: _Chunk, at: int, end: int, scores: np.ndarray, hot: pa.Array, of_hot: np.ndarray) -> pa.RecordBatch:
    """Rows of the texts from ``at`` to ``end``: what the frequent words add up to, and the others."""
    row, n, last = chunk.row, end - at, np.array(chunk.row["last"][at:end])
    split = chunk.words(at, end)
    coded = split.flatten().dictionary_encode()
    place = pc.index_in(coded.dictionary, value_set=hot).fill_null(-1).to_numpy()
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    which = coded.indices.to_numpy()
    of = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    place, word = place[which], ~empty[which]
    there, rare = word & (place >= 0), word & (place < 0)
    stop = int(pc.index_in(pa.array([_END_WORD]), value_set=hot).fill_null(-1)[0].as_py())
    sums = np.bincount(of, np.where(there, of_hot[place], 0.0), n) + last * of_hot[stop]
    seen = np.bincount(of, there, n) + last * (stop >= 0)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(of, rare, n)))).astype(np.int32)
    columns = [
        pa.array(row["uids"][at:end], pa.int64()),
        pa.array(row["ids"][at:end], pa.int64()),
        pa.array((np.bincount(of, word, n) + last).astype(np.int64)),
        pa.array(scores[at:end]),
        pa.array(sums),
        pa.array(seen.astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(offsets), coded.dictionary.take(pa.array(which[rare]))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_tokens", "score", "hot_sum", "hot_known", "rare"])


def _score_batches(bits: int, shipped: Broadcast):
    """Sums of each piece of a text; rows are sorted by chunk and part, texts last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, times = shipped.value
        of_hot = np.append(np.log10(times + 1), 0.0)
        logs: list[bytes] = []
        for row in _rows(batches):
            if row["texts"] is None:
                logs.append(row["logs"])
                continue
            chunk = _Chunk(row)
            scores = _chunk_scores(chunk, logs, bits)
            logs.clear()
            for at, end in chunk.stretches(16 * STEP):
                yield _word_sums(chunk, at, end, scores, hot, of_hot)
            del chunk, scores
            pa.default_memory_pool().release_unused()

    return run


def _scored(texts: DataFrame) -> DataFrame:
    """Scores of the wanted rows of ``texts(doc_id, text, learn, wanted)`` by those to learn from."""
    spark = texts.sparkSession
    ready = texts.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), "learn", "wanted"
    )
    laid = stored(ready.mapInArrow(_lay_batches, _LAID_DDL), "laid")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, math.ceil(size / PART).bit_length())
    asked = stored(laid.mapInArrow(_ask_batches(bits), _ASKED_DDL), "asked")
    grams = asked.where("times is not null").select("part", "codes", "times").repartition(1 << bits, "part").sortWithinPartitions("part")
    counts = stored(grams.mapInArrow(_merge_batches, _COUNTS_DDL), "counts")
    words = stored(asked.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = sums["n"], sums["v"]
    hot = words.where((F.col("n") >= max(1, math.ceil(tokens * HOT))) | (F.col("word") == _END_WORD)).toArrow().combine_chunks()
    shipped = spark.sparkContext.broadcast((pa.array(hot["word"].to_pylist(), pa.string()), hot["n"].to_numpy()))
    table = counts.where("low is not null").groupBy("low").agg(F.sum("n").alias("n")).toArrow()
    low = spark.sparkContext.broadcast((table["low"].to_numpy().astype(np.uint64), table["n"].to_numpy().astype(np.int64)))
    log_below = math.log10(tokens + 1 * (kinds + 1))
    model = counts.where("codes is not null").select("part", F.lit(None).cast("long").alias("chunk"), "codes", "times")
    questions = asked.where("wanted and codes is not null").select("part", "chunk", "codes", F.lit(None).cast("binary").alias("times"))
    answers = (
        model.union(questions)
        .repartition(1 << bits, "part")
        .sortWithinPartitions("part", "chunk")  # a part's model has no chunk and comes first
        .mapInArrow(_answer_batches(uuid.uuid4().hex, low), "chunk long, part int, logs binary")
    )
    answers = stored(answers, "answers")
    low.destroy()
    forget(spark, asked, counts)
    joined = (
        laid.where("wanted")
        .unionByName(answers, allowMissingColumns=True)
        .repartition(1 << bits, "chunk")
        .sortWithinPartitions("chunk", F.col("part").asc_nulls_last())
    )
    schema = "uid long, doc_id long, n_tokens long, score double, hot_sum double, hot_known long, rare array<string>"
    each = stored(joined.mapInArrow(_score_batches(bits, shipped), schema), "scored")
    shipped.destroy()
    forget(spark, laid, answers)
    rare = each.select("uid", F.explode("rare").alias("word")).join(words, "word", "left").groupBy("uid").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("sum"), F.count("n").alias("known")
    )
    whole = each.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "score", "hot_sum", "hot_known"))
    )
    return whole.join(rare, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_below)).alias("base_score"),
        "score",
    )


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Scores every row of ``docs(doc_id, text)`` by what ``train(text)`` has.

    ``doc_id, n_tokens, n_known, train_tokens, base_score, score``. base_score
    is that of single lower-cased words and an end with add-one counts, score
    that of the byte model for the lower-cased text and its end. Null texts are
    empty and have the end only. Without training texts every byte has an equal
    chance. Rows that repeat are each scored.
    """
    flag = lambda df, learn: df.withColumns({"learn": F.lit(learn), "wanted": F.lit(not learn)})
    learned = flag(train.select(F.lit(None).cast("long").alias("doc_id"), "text"), True)
    return _scored(flag(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), False).union(learned))


def op7_ppm(docs: DataFrame) -> DataFrame:
    """The contract's columns: rows whose fold of seven is 2 are held out of the training.

    Null and empty texts have the end only; a null doc_id has the fold of an
    empty text; rows that repeat are each scored and each learned from; other
    columns are ignored; an empty table gives no rows. Very long texts are cut
    into pieces whose sums are added up.
    """
    part = fold(F.col("doc_id"), 7)
    scored = _scored(docs.select("doc_id", "text", (part != 2).alias("learn"), F.lit(True).alias("wanted")))
    return scored.select("doc_id", (part == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
