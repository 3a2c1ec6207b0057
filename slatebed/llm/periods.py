"""Periodic runs of words: every stretch that repeats with a small period.

A run is a stretch of consecutive words with smallest period q, of at least
``max(LEAST_WORDS, TIMES * q)`` words, that no neighbouring word extends. For
a period p the stretch of places whose word equals the one p places on has
then at least ``g = max(LEAST_WORDS, TIMES * p) - p`` places, so it holds one
of the places 0, g, 2g, ... of the text: the harmonic grid. For all periods and
grid points of a batch of texts at once, prefix hashes tell whether half of
such a stretch is there, and a binary search finds how far the words before and
after agree. A run is found at many grid points and also under multiples of its
period; one of each is left, and its words are compared. Should a hash have
lied, the batch is done again with other hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatebed.llm.common import text_or_empty, words

#: The shortest run, and how often its period has to fit into it.
LEAST_WORDS, TIMES = 24, 3
#: Pairs of period and grid point looked at together, and bytes of texts (one at least) whose words are numbered together.
PAIRS, BATCH_BYTES = 1 << 19, 1 << 20
#: Words written at a time.
WRITTEN = 1 << 16
#: Moduli of the two prefix hashes: products of two remainders fit 64 bits.
_PRIMES = (2147483647, 2147483629)


class _Hashes:
    """Prefix hashes of a word sequence by two moduli."""

    def __init__(self, ids: np.ndarray, seed: int):
        draw = np.random.default_rng(seed)
        self.tables = []
        for prime in _PRIMES:
            base = int(draw.integers(1 << 20, prime))
            of_id = draw.integers(1, prime, int(ids.max(initial=0)) + 1, np.uint64)
            modulus = np.uint64(prime)
            power = np.ones(len(ids) + 1, np.uint64)
            known, factor = 1, base
            while known < len(power):  # twice as many powers each round
                power[known : 2 * known] = power[: len(power[known : 2 * known])] * np.uint64(factor) % modulus
                known, factor = 2 * known, factor * factor % prime
            sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(of_id[ids] * power[:-1] % modulus, out=sums[1:])
            self.tables.append((modulus, power, sums % modulus))

    def same(self, at: np.ndarray, period: np.ndarray, length: np.ndarray, tables: int = 2) -> np.ndarray:
        """Whether ``length`` words from ``at`` seem to be those from ``at + period``."""
        found = np.ones(len(at), bool)
        for modulus, power, sums in self.tables[:tables]:
            here = (sums[at + length] + modulus - sums[at]) % modulus
            there = (sums[at + period + length] + modulus - sums[at + period]) % modulus
            found &= here * power[period] % modulus == there
        return found


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All (text, period, grid point), at most PAIRS of them or those of one period at a time."""
    periods = np.where(sizes >= LEAST_WORDS, sizes // TIMES, 0)
    for texts in _parts(periods, PAIRS):
        text = np.repeat(texts, periods[texts])
        period = 1 + np.arange(len(text)) - np.repeat(np.cumsum(periods[texts]) - periods[texts], periods[texts])
        step = np.maximum(LEAST_WORDS, TIMES * period) - period
        points = -(-(sizes[text] - period) // step)
        for rows in _parts(points, PAIRS):
            times = points[rows]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield np.repeat(text[rows], times), np.repeat(period[rows], times), place * np.repeat(step[rows], times)


def _parts(weights: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Consecutive numbers whose weights sum up to at most ``most``, or one number."""
    ends, low = np.cumsum(weights), 0
    while low < len(weights):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield np.arange(low, high)
        low = high


def _reach(hashes: _Hashes, at: np.ndarray, period: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """How many words from ``at`` on, or before it, equal those a period later, up to ``limit``."""
    found = np.zeros(len(at), np.int64)
    step = 1 << int(limit.max(initial=0)).bit_length()
    while step:
        longer = found + step
        fits = np.flatnonzero(longer <= limit)
        first = at[fits] - longer[fits] if back else at[fits]
        good = fits[hashes.same(first, period[fits], longer[fits])]
        found[good] = longer[good]
        step >>= 1
    return found


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of all runs, by text, start and period.

    ``ids`` are the numbered words of texts laid end to end, ``sizes`` their
    word counts; starts count from the text's first word.
    """
    ids, sizes = np.asarray(ids, np.int64), np.asarray(sizes, np.int64)
    seed = 0
    while True:
        found = _runs_by_hashes(ids, sizes, _Hashes(ids, seed))
        if _verified(ids, sizes, *found):
            return found
        seed += 1


def _runs_by_hashes(ids: np.ndarray, sizes: np.ndarray, hashes: _Hashes) -> tuple[np.ndarray, ...]:
    begins = np.cumsum(sizes) - sizes
    parts = [np.zeros((4, 0), np.int64)]
    for text, period, point in _grid(sizes):
        at = begins[text] + point
        alike = np.flatnonzero(ids[at] == ids[at + period])
        text, period, at = text[alike], period[alike], at[alike]
        low, high = begins[text], begins[text] + sizes[text]
        # of so many places half lie on one side of the grid point
        half = (np.maximum(LEAST_WORDS, TIMES * period) - period + 1) // 2
        likely = np.zeros(len(at), bool)
        after, before = np.flatnonzero(at + period + half <= high), np.flatnonzero(at - half >= low)
        likely[after] = hashes.same(at[after], period[after], half[after], 1)
        likely[before] |= hashes.same(at[before] - half[before], period[before], half[before], 1)
        text, period, at, low, high = (x[likely] for x in (text, period, at, low, high))
        forward = _reach(hashes, at, period, high - at - period, False)
        backward = _reach(hashes, at, period, at - low, True)
        length = forward + backward + period
        long = length >= np.maximum(LEAST_WORDS, TIMES * period)
        found = np.stack((text, at - backward - low, length, period))[:, long]
        parts.append(_one_each(found))
    return tuple(_one_each(np.concatenate(parts, axis=1)))


def _one_each(found: np.ndarray) -> np.ndarray:
    """Of equal stretches that with the least period, by text, start and period.

    A stretch that has a period and multiples of it extends as far under each.
    """
    text, start, length, period = found
    order = np.lexsort((period, length, start, text))
    found = found[:, order]
    if found.shape[1]:
        new = np.ones(found.shape[1], bool)
        new[1:] = (found[:3, 1:] != found[:3, :-1]).any(axis=0)
        found = found[:, new]
    return found[:, np.lexsort((found[3], found[1], found[0]))]


def _verified(ids: np.ndarray, sizes: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bool:
    """Whether the words of every run repeat with its period and its neighbours' don't."""
    begins = np.cumsum(sizes) - sizes
    first = begins[text] + start
    for a, n, p, low, high in zip(first.tolist(), length.tolist(), period.tolist(), begins[text].tolist(), (begins + sizes)[text].tolist()):
        if not np.array_equal(ids[a : a + n - p], ids[a + p : a + n]):
            return False
        if (a > low and ids[a - 1] == ids[a - 1 + p]) or (a + n < high and ids[a + n] == ids[a + n - p]):
            return False
    return True


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts, word counts and the word of each number."""
    number: dict[bytes, int] = {}
    ids, sizes = [np.zeros(0, np.int32)], []
    for text in texts:
        size, at = 0, 0
        while at < len(text):
            end = min(len(text), at + BATCH_BYTES)
            while end < len(text) and text[end] not in b" \t\n\v\f\r":
                end += 1
            found = np.fromiter((number.setdefault(w, len(number)) for w in text[at:end].split()), np.int32)
            ids.append(found)
            size += len(found)
            at = end
        sizes.append(size)
    return np.concatenate(ids), np.array(sizes, np.int64), list(number)


def _collapsed(ids: np.ndarray, spelled: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of all runs' later periods, joined by one space."""
    change = np.zeros(len(ids) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    left = ids[np.cumsum(change[:-1]) == 0]
    return b" ".join(b" ".join(spelled[i] for i in left[low : low + WRITTEN].tolist()) for low in range(0, len(left), WRITTEN))




_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: Column, key: str = "doc_id") -> DataFrame:
    """``key, n_words, runs, collapsed`` of each row: its runs by start, then
    period, and its words without those that a run contains after its first
    period, joined by one space.

    A null text has no words. Each row is done by itself, whatever its key, so
    rows that repeat give rows that repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
            for rows in _parts(sizes, BATCH_BYTES):
                low, n = int(rows[0]), len(rows)
                found = list(_of_texts(column.slice(low, n).cast(pa.binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(low, n),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in f[1]] for f in found], pa.list_(_RUN)),
                        pa.array([f[2] for f in found], pa.binary()).cast(pa.string()),
                    ],
                    [key, "n_words", "runs", "collapsed"],
                )

    one = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(text, F.lit("")).alias("text"))
    kind = one.schema[key].dataType.simpleString()
    return one.mapInArrow(run, f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _of_texts(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    ids, sizes, spelled = _numbered(texts)
    text, *of = find_runs(ids, sizes)
    starts = np.searchsorted(text, np.arange(len(sizes) + 1))
    begins = np.cumsum(sizes) - sizes
    for i, n in enumerate(sizes.tolist()):
        runs = list(zip(*(x[starts[i] : starts[i + 1]].tolist() for x in of)))
        yield n, runs, _collapsed(ids[begins[i] : begins[i] + n], spelled, runs)


def rewritten(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the contract's ``text``: of every tenth document by hash the end is made periodic.

    A null doc_id has the hash of an empty text and a null text has no words;
    other texts are left as they are.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    one = docs.select("doc_id", text_or_empty().alias("_text"), F.floor(h / 10).cast("long").alias("_g"), (h % 10 == 0).alias("_chosen"))
    # a column of its own: the words must not be split again for each of them
    two = one.withColumn("_words", F.when(F.col("_chosen"), words(F.col("_text"))))
    n = F.size("_words").cast("long")
    a = F.col("_g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8)).cast("long")
    three = two.withColumns({"_a": F.when(n > 0, a), "_p": F.when(n > 0, p)})
    moved = F.transform(
        "_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    )
    return three.select("doc_id", F.when(F.col("_p").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("_text")).alias("text"))


def op13_periodic_runs(docs: DataFrame) -> DataFrame:
    """The contract's columns from the runs and collapsed texts of all documents.

    Null and empty texts have no words and no run; repeated rows give repeated
    rows; a null doc_id has the hash of an empty text; other columns are
    ignored; an empty table gives no rows.
    """
    found = periodic_runs(rewritten(docs), F.col("text"))
    # exact fractions; runs come by start, then period, and only a larger one replaces an earlier one
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        found.withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            "best.start",
            "best.length",
            "best.period",
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
