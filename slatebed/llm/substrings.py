"""Removal of byte strings that occur more than once, by suffix arrays.

Every string of ``WINDOW`` bytes owns an anchor, the ``GRAM`` bytes in it with
the least hash, so equal strings own equal anchors at equal offsets. Strings in
a row with the same anchor form a segment, and every string is in exactly one.
Segments are grouped by the hash of their anchor, wherever they are in the
corpus:

* A segment that occurs again as a whole is repeated as a whole.
* Of the others, those that share an anchor with a different segment come
  together as one short text for each anchor. Its suffix array puts equal
  strings next to each other, which says which of them are repeated.
* Anchors of very many different segments (the edges of a passage that
  thousands of documents quote) have their strings counted one by one.

Segments and strings of crowded anchors are compared by 64-bit hashes within
equal 64-bit hashes of the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatebed.llm.common import forget, scratch, stored, text_or_empty
from slatebed.llm.lyndon import suffix_arrays

WINDOW, GRAM = 200, 64
#: Different segments of one anchor beyond which strings are counted one by one.
CROWDED = 24
RANGE = 8
#: Bytes of a text that are cut into segments at a time, and of texts for suffix arrays.
PIECE, BLOCK = 1 << 20, 1 << 20
#: Bytes of texts whose suffix arrays are built in lockstep; a step costs as much for few as for many.
LOCKSTEP = 1 << 20
#: Stretches round an anchor of which every string covers one, and the bytes by which they differ.
STEPS = 8
STEP = (WINDOW - GRAM) // STEPS
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, those of its inverse, and a value for each byte."""
    n = PIECE + WINDOW + 1
    up, down = (
        np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, q, np.uint64))), dtype=np.uint64)
        for q in (_ODD, pow(_ODD, -1, 1 << 64))
    )
    return up, down, _mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = x ^ (x >> np.uint64(33))
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class _Hashes:
    """Hashes of any substring of a text of at most PIECE + WINDOW bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down, values = _powers()
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(values[data] * up[: len(data)], dtype=np.uint64)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self) -> np.ndarray:
        """The hashes of all substrings of GRAM bytes."""
        found = self.sums[GRAM:] - self.sums[:-GRAM]
        found *= self.down[: len(found)]
        return _mixed(found)


def segments(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, segment hash, first string, last string) of the segments of a text."""
    for at in range(0, len(data) - WINDOW + 1, PIECE - WINDOW):
        part = data[at : at + PIECE - 1]
        hashes = _Hashes(part)
        gram = hashes.grams()
        # the least hash, the leftmost of equal ones
        ranked = gram & ~np.uint64(PIECE - 1)
        ranked |= np.arange(len(gram), dtype=np.uint64)
        width, n = WINDOW - GRAM + 1, len(part) - WINDOW + 1
        rows = np.concatenate((ranked, np.full(-len(ranked) % width, 2**64 - 1, np.uint64))).reshape(-1, width)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64(PIECE - 1)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        low, high = np.concatenate(([0], cuts)), np.append(cuts, n) - 1
        whole = hashes(low, high + WINDOW) + (high - low).astype(np.uint64)
        yield gram[anchor[low]], _mixed(whole), low + at, high + at


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "seg", "low", "high", "doc_id", "th"]
    for batch in batches:
        held, size = [], 0
        for doc_id, th, text in zip(*(batch.column(i) for i in range(3))):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for key, seg, low, high in segments(data):
                held.append((key.view(np.int64), seg.view(np.int64), low.astype(np.int32), high.astype(np.int32), doc_id, th))
                size += len(key)
            if size >= 1 << 16:
                yield _segment_rows(held, names)
                held, size = [], 0
        if held:
            yield _segment_rows(held, names)


def _segment_rows(held: list, names: list[str]) -> pa.RecordBatch:
    sizes = [len(h[0]) for h in held]
    columns = [pa.array(np.concatenate([h[i] for h in held])) for i in range(4)]
    for i in (4, 5):
        values = pa.array([h[i].as_py() for h in held], pa.int64())
        columns.append(values.take(pa.array(np.repeat(np.arange(len(held)), sizes))))
    return pa.RecordBatch.from_arrays(columns, names)


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for batch in batches:
        rows = []
        for doc_id, th, text, wanted in zip(*(batch.column(i) for i in range(4))):
            data = text.as_buffer()
            for w in wanted.as_py():
                rows.append((w["key"], w["single"], w["crowded"], doc_id.as_py(), th.as_py(), w["low"], data[w["low"] : w["high"] + WINDOW].to_pybytes()))
        if rows:
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "single", "crowded", "doc_id", "th", "low", "data"])


def repeated_strings(groups: list[list[bytes]]) -> list[list[np.ndarray]]:
    """For each group the starts in each of its texts of strings found elsewhere in the group."""
    out: list[list[np.ndarray]] = [[] for _ in groups]
    order = sorted(range(len(groups)), key=lambda g: sum(map(len, groups[g])))
    at = 0
    while at < len(order):
        # groups that are done leave the lockstep, so lengths may differ
        some, size = [], 0
        while at < len(order) and (not some or size < LOCKSTEP):
            some.append(order[at])
            size += sum(map(len, groups[order[at]]))
            at += 1
        for g, found in zip(some, _repeated([groups[g] for g in some])):
            out[g] = found
    return out


def _repeated(groups: list[list[bytes]]) -> list[list[np.ndarray]]:
    most = max(map(len, groups))
    texts = [t for group in groups for t in group]
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    stops = np.cumsum(sizes + 1) - 1
    begins = stops - sizes
    symbols = data.astype(np.int64) + most
    # each text ends with a symbol of its own, the last of a group with the smallest
    symbols[stops] = np.concatenate([np.arange(len(g))[::-1] for g in groups])
    bounds = np.concatenate(([0], stops[np.cumsum([len(g) for g in groups]) - 1] + 1))
    sa = suffix_arrays(symbols, bounds)
    left = np.repeat(stops, sizes + 1) - np.arange(len(data))  # bytes up to the end of the text
    string = np.repeat(np.arange(len(groups)), np.diff(bounds))
    a, b = sa[:-1], sa[1:]
    pair = (string[:-1] == string[1:]) & (left[a] >= WINDOW) & (left[b] >= WINDOW)
    a, b = a[pair], b[pair]
    same = data[a + WINDOW // 2] == data[b + WINDOW // 2]
    a, b = a[same], b[same]
    for part in range(0, len(data), PIECE):  # hashes of a bounded stretch at a time
        if part == 0 and len(data) <= PIECE + WINDOW:
            hashes = _Hashes(data)
            ha, hb = hashes(a, a + WINDOW), hashes(b, b + WINDOW)
            break
        if part == 0:
            ha, hb = np.zeros(len(a), np.uint64), np.zeros(len(b), np.uint64)
        hashes = _Hashes(data[part : part + PIECE + WINDOW])
        for x, h in ((a, ha), (b, hb)):
            here = (x >= part) & (x < part + PIECE)
            h[here] = hashes(x[here] - part, x[here] - part + WINDOW)
    # equal hashes are looked at byte by byte
    at = np.flatnonzero(ha == hb)
    equal = np.zeros(len(a), bool)
    views = np.lib.stride_tricks.sliding_window_view(data, WINDOW) if len(at) else data
    for low in range(0, len(at), BLOCK // WINDOW):
        some = at[low : low + BLOCK // WINDOW]
        equal[some] = (views[a[some]] == views[b[some]]).all(axis=1)
    marked = np.zeros(len(data), bool)
    marked[a[equal]] = marked[b[equal]] = True
    starts = np.flatnonzero(marked)
    which = np.searchsorted(begins, starts, side="right") - 1
    cut = np.searchsorted(which, np.arange(len(texts) + 1))
    found, t = [], 0
    for group in groups:
        found.append([starts[cut[t + i] : cut[t + i + 1]] - begins[t + i] for i in range(len(group))])
        t += len(group)
    return found


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    gaps = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate(([0], gaps + 1))], starts[np.append(gaps, len(starts) - 1)]


def _with_partners(rows: list[tuple]) -> list[list[tuple]]:
    """Segments in groups with those of the same anchor that may share a string with them.

    A string has its anchor at most WINDOW - GRAM bytes after its start, so it
    covers one of STEPS stretches round the anchor that have all but a
    STEPS-th of those bytes. Two segments with an equal string have that
    stretch in common; segments connected by stretches are a group, and one
    whose stretches are all its own has no string of another. What lies beyond
    the strings around common stretches is cut off.
    """
    found = np.zeros((len(rows), STEPS), np.uint64)
    there = np.zeros((len(rows), STEPS), bool)
    anchors = np.zeros(len(rows), np.int64)
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (end == at or size + len(rows[end][5]) <= PIECE):
            size += len(rows[end][5])
            end += 1
        sizes = np.array([len(r[5]) for r in rows[at:end]])
        stops = np.cumsum(sizes)
        begins = stops - sizes
        hashes = _Hashes(np.frombuffer(b"".join(r[5] for r in rows[at:end]), np.uint8))
        grams = hashes.grams()
        keys = np.repeat(np.array([r[0] for r in rows[at:end]], np.int64), sizes)[: len(grams)]
        hit = np.flatnonzero(grams.view(np.int64) == keys)
        anchor = hit[np.searchsorted(hit, begins)]  # the first one in each segment
        anchors[at:end] = anchor - begins
        for k in range(STEPS):
            low = anchor - k * STEP
            high = anchor + GRAM + (STEPS - 1 - k) * STEP
            inside = np.flatnonzero((low >= begins) & (high <= stops))
            there[at + inside, k] = True
            found[at + inside, k] = _mixed(hashes(low[inside], high[inside]) + np.uint64(k))
        at = end
    values, of, times = np.unique(found[there], return_inverse=True, return_counts=True)
    common = times[of] > 1
    row, step = (x[common] for x in np.nonzero(there))
    of = of[common]
    group = np.arange(len(rows))  # the first segment that each is connected to
    while True:
        least = np.full(len(values), len(rows))
        np.minimum.at(least, of, group[row])
        new = group.copy()
        np.minimum.at(new, row, least[of])
        if (new == group).all():
            break
        group = new
    # a string with its anchor after o bytes covers stretch o // STEP, or the last
    first, last = np.full(len(rows), WINDOW), np.zeros(len(rows), np.int64)
    np.maximum.at(last, row, np.where(step == STEPS - 1, WINDOW - GRAM, (step + 1) * STEP - 1))
    np.minimum.at(first, row, step * STEP)
    low, high = np.maximum(0, anchors - last).tolist(), (anchors - first + WINDOW).tolist()
    cut = lambda i: (*rows[i][:4], rows[i][4] + low[i], rows[i][5][low[i] : high[i]])
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.diff(group[order])) + 1
    parts = [part.tolist() for part in np.split(order, edges) if len(part) > 1]
    return [[cut(i) for i in part] for part in parts if any(rows[i][1] for i in part)]


def _array_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated strings from rows that come sorted by key."""

    def spans(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for group, found in zip(groups, repeated_strings([[r[5] for r in group] for group in groups])):
            for (_, single, doc_id, th, low, _), starts in zip(group, found):
                if single and len(starts):
                    for first, last in zip(*map(np.ndarray.tolist, _runs(starts))):
                        rows.append((doc_id, th, low + first, low + last + WINDOW))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "th", "low", "high"])

    groups: list[list[tuple]] = []
    rows: list[tuple] = []
    size = held = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if size >= PIECE and rows[-1][0] != row[0]:  # all of an anchor are looked at together
                some = _with_partners(rows)
                groups, held, rows, size = groups + some, held + sum(len(r[5]) for g in some for r in g), [], 0
                if held >= 2 * LOCKSTEP:
                    yield from spans(groups)
                    groups, held = [], 0
            rows.append(row)
            size += len(row[5])
    if rows:
        groups += _with_partners(rows)
    if groups:
        yield from spans(groups)


def _range_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of the segments of crowded anchors, in ranges of up to RANGE neighbours.

    Ranges are cut by the distance to the anchor, so equal texts around equal
    anchors have equal ranges. ``whole`` is the hash of a range's text,
    ``strings`` has those of its strings, and ``core`` that of the bytes which
    any string of this place has.
    """
    names = ["key", "place", "whole", "core", "at", "n", "strings", "single", "doc_id", "th"]
    for batch in batches:
        parts, strings, lengths = [], [], []
        for key, single, doc_id, th, low, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
            hashes = _Hashes(np.frombuffer(data, np.uint8))
            anchor = int(np.flatnonzero(hashes.grams().view(np.int64) == key)[0])
            starts = np.arange(len(data) - WINDOW + 1)
            place = (anchor - starts) // RANGE
            first = np.flatnonzero(np.concatenate(([True], np.diff(place) != 0)))
            last = np.append(first[1:], len(starts)) - 1
            whole = _mixed(hashes(first, last + WINDOW) + (last - first).astype(np.uint64) * np.uint64(_ODD))
            inner = anchor - RANGE * place[first]
            core = hashes(inner, inner + WINDOW - RANGE + 1)
            strings.append(hashes(starts, starts + WINDOW).view(np.int64))
            lengths.append(last - first + 1)
            parts.append((place[first], whole.view(np.int64), core.view(np.int64), first + low, key, single, doc_id, th))
        if parts:
            of = pa.array(np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]))
            n = np.concatenate(lengths)
            place, whole, core, at = (np.concatenate([p[i] for p in parts]) for i in range(4))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(strings)))
            key, single, doc_id, th = (
                pa.array([p[i] for p in parts], kind).take(of) for i, kind in ((4, pa.int64()), (5, pa.bool_()), (6, pa.int64()), (7, pa.int64()))
            )
            columns = [key, pa.array(place, pa.int32()), pa.array(whole), pa.array(core), pa.array(at, pa.int32()), pa.array(n, pa.int32()), lists, single, doc_id, th]
            yield pa.RecordBatch.from_arrays(columns, names)


def crowded_spans(cut: DataFrame) -> DataFrame:
    """Spans of repeated strings among the segments of crowded anchors.

    A range that occurs again is repeated as a whole. Where a range of an
    anchor and place does not, its strings are counted together with those of
    the other ranges of that place that have the same core, one of each kind;
    without the same core no string can be the same.
    """
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(
        cut.repartition(parts).mapInArrow(
            _range_batches, "key long, place int, whole long, core long, at int, n int, strings array<long>, single boolean, doc_id long, th long"
        ),
        "ranges",
    )
    of = ["key", "place", "whole"]
    kinds = stored(
        ranges.groupBy(*of).agg(
            F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("core", "strings", "at", "doc_id", "th")), F.bool_or("single").alias("single")
        ),
        "kinds",
    )
    again = kinds.where("times > 1").select(*of)
    whole = ranges.where("single").join(again, of).select("doc_id", "th", F.col("at").alias("low"), (F.col("at") + F.col("n") - 1 + WINDOW).alias("high"))
    open_places = kinds.groupBy("key", "place", "core").agg(F.sum((F.col("times") == 1).cast("int")).alias("alone"), F.count("*").alias("kinds")).where("alone > 0 and kinds > 1")
    strings = stored(
        kinds.join(open_places, ["key", "place", "core"]).select(
            "key", (F.col("single") & (F.col("times") == 1)).alias("single"), "doc_id", "th", "at", F.posexplode("strings").alias("i", "hash")
        ),
        "strings",
    )
    twice = strings.groupBy("key", "hash").agg(F.count("*").alias("times")).where("times > 1").select("key", "hash")
    counted = strings.where("single").join(twice, ["key", "hash"]).select(
        "doc_id", "th", (F.col("at") + F.col("i")).alias("low"), (F.col("at") + F.col("i") + WINDOW).alias("high")
    )
    return whole.union(counted)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, th, spans``: byte ranges to remove from the texts whose hash is th."""
    with scratch(docs.sparkSession) as stay:
        spans = _spans(docs)
        stay.append(spans)
    return spans


def _spans(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    every = stored(
        texts.select("doc_id", "th", "text").mapInArrow(_segment_batches, "key long, seg long, low int, high int, doc_id long, th long"), "segments"
    )
    kinds = every.groupBy("key", "seg").agg(
        F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.first("low").alias("low"), F.first("high").alias("high")
    )
    anchors = kinds.groupBy("key").agg(F.count("*").alias("d"), F.sum((F.col("n") == 1).cast("int")).alias("singles")).where("d > 1 and singles > 0")
    wanted = stored(
        kinds.join(anchors, "key").select(
            "key", (F.col("n") == 1).alias("single"), (F.col("d") > CROWDED).alias("crowded"), "doc_id", "th", "low", "high"
        ),
        "wanted",
    )
    again = stored(kinds.where("n > 1").select("key", "seg"), "again")
    whole = stored(
        every.join(again, ["key", "seg"]).select("doc_id", "th", "low", (F.col("high") + WINDOW).alias("high")), "whole"
    )
    forget(spark, every)
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "single", "crowded", "low", "high")).alias("wanted"))
    t, w = texts.alias("t"), lists.alias("w")
    cut = stored(
        t.join(w, F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.th") == F.col("w.th")))
        .select("t.doc_id", "t.th", "t.text", "wanted")
        .mapInArrow(_cut_batches, "key long, single boolean, crowded boolean, doc_id long, th long, low int, data binary"),
        "cut",
    )
    columns = ["key", "single", "doc_id", "th", "low", "data"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = cut.where("not crowded").select(columns).repartition(parts, "key").sortWithinPartitions("key")
    arrays = sorted_rows.mapInArrow(_array_batches, "doc_id long, th long, low int, high int")
    counted = crowded_spans(cut.where("crowded").select(columns))
    spans = whole.union(arrays).union(counted)
    return stored(spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")


def _kept(data: memoryview, spans: list | None) -> tuple[bytes, int]:
    """The bytes outside of the spans, and how many maximal runs were taken out."""
    if not spans:
        return bytes(data), 0
    low = np.array([s["low"] for s in spans])
    high = np.array([s["high"] for s in spans])
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate(([True], low[1:] > high[:-1]))
    first, last = low[new], high[np.append(np.flatnonzero(new)[1:], len(low)) - 1]
    edges = [0, *np.stack((first, last), axis=1).ravel().tolist(), len(data)]
    return b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2])), len(first)


def _kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2)):
            data = memoryview(text.as_buffer())
            kept, runs = _kept(data, spans.as_py())
            rows.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if runs else None))
        numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        rest = [pa.array([r[i] for r in rows], pa.string()) for i in (3, 4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, *rest], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def without_repeats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Struct ``row`` of the columns to keep, counts, digest and the text that is left.

    Every byte goes that is covered by a string of 200 bytes which starts
    anywhere else in the corpus, overlaps and the same text included; all
    occurrences go. Null texts are empty; texts under 200 bytes lose nothing.
    Rows that repeat doc_id and text are occurrences of each other. kept_text
    is null where nothing went; bytes of a character that was cut in two are
    left out of it, but not of the digest.
    """
    full = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    spans = repeated_spans(full.select("doc_id", "text"))
    t, s = full.withColumn("th", F.xxhash64("text")).alias("t"), spans.alias("s")
    joined = t.join(s, F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.th") == F.col("s.th")), "left").select("row", "t.text", "spans")
    schema = full.select("row").schema["row"].dataType.simpleString()
    return joined.mapInArrow(_kept_batches, f"row {schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def op3_suffix_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns; see :func:`without_repeats`.

    Null texts are empty, rows that repeat are occurrences of each other, a
    null doc_id is kept, other columns are ignored, an empty table gives no rows.
    """
    return without_repeats(docs, ["doc_id"]).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts, columns as they came; those left empty go.

    Null and empty texts stay as they are. Rows that repeat a text of 200 bytes
    or more are occurrences of each other and lose all of it, whichever doc_id
    they have; n_chars follows a text that was cut.
    """
    done = without_repeats(docs, docs.columns)
    text = F.coalesce("kept_text", "row.text")
    changed = {"text": text, "n_chars": F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text").cast("long"))} if "n_chars" in docs.columns else {"text": text}
    return done.where("n_spans = 0 or kept_text rlike '[^ \\\\x09-\\\\x0D]'").select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
