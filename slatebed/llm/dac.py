"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level k holds the k-th
chunks of all ids that have one, and a bitmap that says which of them go on to
level k+1. A rank directory with the number of ones before each block of 512
bits turns a position on one level into its position on the next, so any token
is found by one read per level and no block is decoded.

A file is a Parquet table in the shared folder whose rows are shards: the
documents of a range of doc_ids in ascending order, and their codes as bytes.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatebed.llm.common import new_path, text_or_empty

CHUNK_BITS, BLOCK_BITS = 8, 512
#: A shard is closed by the document that takes it to so many tokens.
SHARD_TOKENS = 1 << 19
#: Words that a worker remembers.
REMEMBERED = 1_000_000
#: Bytes of text whose words are looked up together, and words that the library sees in one text.
SLICE, JOINED = 1 << 24, 500
_MAGIC = b"DAC1"
_MARKS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
_ENDING = "(?P<marks>[" + "".join("\\" + c for c in _MARKS) + "]+)$"


def dac_encode(ids: np.ndarray) -> bytes:
    """ids of 0 to 2**32-1 to bytes: magic, n, levels, then per level its parts."""
    left = ids.astype(np.uint32)
    levels = []
    while True:
        chunks = (left & np.uint32(255)).astype(np.uint8)
        goes = left > 255
        bitmap = np.packbits(goes, bitorder="little")
        ones = np.add.reduceat(goes, np.arange(0, len(goes), BLOCK_BITS), dtype=np.uint64) if len(goes) else np.zeros(0, np.uint64)
        ranks = (np.cumsum(ones, dtype=np.uint64) - ones).astype("<u8")
        levels.append((chunks, bitmap, ranks))
        left = left[goes] >> np.uint32(CHUNK_BITS)
        if not len(left):
            break
    head = [_MAGIC, np.array([len(ids), len(levels), *(len(c) for c, _, _ in levels)], "<u8").tobytes()]
    return b"".join(head + [part.tobytes() for level in levels for part in level])


class Dac:
    """The codes of one shard, read in place."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a DAC shard")
        self.n, count = (int(x) for x in np.frombuffer(data, "<u8", 2, 4))
        sizes = np.frombuffer(data, "<u8", count, 20).tolist()
        at = 20 + 8 * count
        self.levels = []
        for size in sizes:
            parts = []
            for kind, n in ((np.uint8, size), (np.uint8, -(-size // 8)), ("<u8", -(-size // BLOCK_BITS))):
                parts.append(np.frombuffer(data, kind, n, at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def __getitem__(self, i: int) -> int:
        """One token, without decoding any other."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            start = block * BLOCK_BITS
            before = np.unpackbits(bitmap[start >> 3 : (i >> 3) + 1], count=i - start, bitorder="little")
            i = int(ranks[block]) + int(before.sum())
        return value

    def slice(self, i: int, j: int) -> np.ndarray:
        """The tokens of places i to j, by one stretch of each level and no other block."""
        size = j - i
        out, at = np.zeros(size, np.uint32), np.arange(size)
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            out[at] |= chunks[i:j].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            if i >= j:
                break
            block = i // BLOCK_BITS
            first = block * BLOCK_BITS
            bits = np.unpackbits(bitmap[first >> 3 : (j + 7) >> 3], count=j - first, bitorder="little").astype(bool)
            goes = bits[i - first :]
            at = at[goes]
            if not len(at):
                break
            i = int(ranks[block]) + int(np.count_nonzero(bits[: i - first]))
            j = i + len(at)
        return out

    def all(self) -> np.ndarray:
        """Every token."""
        return self.slice(0, self.n)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordMemo:
    """Words and their ids by the tokenizers library, which sees each distinct word about once.

    It is meant for tokenizers that lower case, drop white space and never join
    text across it, so a text's ids are those of its words one after the other.
    They also part letters from marks, so a word that ends with marks after a
    letter has the ids of its plain form and those of the marks; only what has
    a plain form of its own goes through the library. Words of letters alone
    are one unit of the tokenizer, which ends with a token of the word-end
    kind; they go through the library many to a text and are cut apart there.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        model = json.loads(spec)["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _put(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remembers words whose ids lie one after the other, under the next numbers."""
        n, used = len(self.known), self.used
        while n + len(words) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[used : used + len(ids)] = ids
        self.sizes[n : n + len(words)] = sizes
        self.starts[n : n + len(words)] = used + np.cumsum(sizes) - sizes
        self.known.update(zip(words, range(n, n + len(words))))
        self.used = used + len(ids)

    def _apart(self, words: list[str]) -> None:
        coded = [c.ids for c in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._put(words, np.array([i for ids in coded for i in ids], np.uint32), np.array([len(ids) for ids in coded], np.int64))

    def _together(self, words: list[str]) -> None:
        """Words of letters alone; what does not come back as so many units is coded one by one."""
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                self._put(some, ids, np.diff(stops, prepend=0))
            else:
                self._apart(some)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Their numbers, -1 for those not known."""
        get = self.known.get
        return np.fromiter([get(w, -1) for w in words], np.int64, len(words))

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words that were not known."""
        special = pc.match_substring(words, "<")  # may start a special token, which is matched as written
        stems = pc.utf8_rtrim(words, characters=_MARKS)
        after_letter = pc.utf8_is_alpha(pc.utf8_slice_codeunits(stems, start=-1))
        cut = pc.and_not(pc.and_(after_letter, pc.not_equal(stems, words)), special)
        plain = pc.if_else(cut, stems, words)
        # letters that are lowered alike everywhere
        low = pc.and_not(pc.match_substring_regex(plain, r"(?s)^[\x{00}-\x{ff}]*$"), special)
        plain = pc.if_else(low, pc.utf8_lower(plain), plain)
        with_marks = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        marks = pc.extract_regex(words.take(pa.array(with_marks)), _ENDING).field(0)
        parts = pa.concat_arrays([plain, marks.cast(plain.type)]).dictionary_encode()
        spelled = parts.dictionary.to_pylist()
        number = self._numbers(spelled)
        fresh = number < 0
        if self.ends is not None:
            letters = fresh & pc.utf8_is_alpha(parts.dictionary).to_numpy(zero_copy_only=False)
            self._together([spelled[i] for i in np.flatnonzero(letters)])
            fresh &= ~letters
        self._apart([spelled[i] for i in np.flatnonzero(fresh)])
        number = self._numbers(spelled)[parts.indices.to_numpy()]
        found, of_marks = number[: len(words)], np.zeros(len(words), np.int64)
        of_marks[with_marks] = number[len(words) :]
        # a word that is no part of one gets a number of its own
        other = np.flatnonzero(pc.or_(cut, pc.not_equal(plain, words)).to_numpy(zero_copy_only=False))
        pair = np.stack((found[other], of_marks[other]), axis=1)
        first = len(self.known)
        ids = self.ids[_ranges(self.starts[pair.ravel()], self.sizes[pair.ravel()])]
        self._put(words.take(pa.array(other)).to_pylist(), ids, self.sizes[pair].sum(axis=1))
        found[other] = first + np.arange(len(other))
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and how many each has."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.clear()
        number = self._numbers(coded.dictionary.to_pylist())
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            number[fresh] = self._learn(coded.dictionary.take(pa.array(fresh)))
        offsets = split.offsets.to_numpy()
        # one more word a text, of the number -1, for its end
        words = np.insert(number[coded.indices.to_numpy()], offsets[1:], -1) if len(number) else np.full(len(texts), -1)
        last = offsets[1:] + np.arange(len(texts))
        sizes = np.where(words < 0, 1, self.sizes[words])
        starts = np.where(words < 0, 0, self.starts[words])
        ids = self.ids[_ranges(starts, sizes)]
        ends = np.cumsum(sizes)[last]
        ids[ends - 1] = end_id
        return ids, np.diff(ends, prepend=0)


_MEMOS: dict[int, WordMemo] = {}


def _memo(spec: str) -> WordMemo:
    if hash(spec) not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[hash(spec)] = WordMemo(spec)
    return _MEMOS[hash(spec)]


_SHARD = "part int, before long, n_tokens long, doc_ids array<long>, sizes array<long>, codes binary"


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about SLICE bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield at, end
        at = end


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Writes all documents' ids, each followed by ``end_id``, in ascending doc_id order.

    Null and empty texts have the end id only. A null doc_id sorts first; rows
    with equal doc_id follow each other in the order of a hash of their texts.
    Texts are dealt out by ranges of both, so a source, a group of copies or of
    rows without doc_id makes no large task.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, before = _memo(shipped.value), TaskContext.get().partitionId(), 0
        doc_ids, ids, sizes, total = [], [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = np.concatenate(sizes)
            listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([total], pa.int64()),
                    listed(pa.concat_arrays(doc_ids)),
                    listed(pa.array(lengths, pa.int64())),
                    pa.array([dac_encode(np.concatenate(ids))], pa.binary()),
                ],
                ["part", "before", "n_tokens", "doc_ids", "sizes", "codes"],
            )

        for batch in batches:
            for at, end in _slices(batch.column(1)):
                coded, lengths = memo.encode(batch.column(1).slice(at, end - at), end_id)
                ends, done = np.cumsum(lengths), 0
                while done < len(lengths):
                    start = int(ends[done - 1]) if done else 0
                    # the documents up to the one that fills the shard
                    stop = min(len(lengths), int(np.searchsorted(ends, start + SHARD_TOKENS - total)) + 1)
                    doc_ids.append(batch.column(0).slice(at + done, stop - done))
                    ids.append(coded[start : int(ends[stop - 1])])
                    sizes.append(lengths[done:stop])
                    total += int(ends[stop - 1]) - start
                    done = stop
                    if total >= SHARD_TOKENS:
                        yield shard()
                        before += total
                        doc_ids, ids, sizes, total = [], [], [], 0
        if sizes:
            yield shard()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(run, _SHARD)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, out of the files.

    Each document's ids are read at their own places; no shard is decoded whole.
    start counts the ids of all documents before it: those of earlier parts,
    summed from one total for each part (a number the session sets, so small
    enough to broadcast), and those before it in its own part.
    """
    shards = spark.read.schema(_SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, sizes, codes, start = (batch.column(i)[row].as_py() for i in range(4))
                shard, ends = Dac(codes), np.cumsum(sizes)
                sums = [zlib.crc32(shard.slice(e - s, e).astype("<u4")) for s, e in zip(sizes, ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return (
        shards.join(F.broadcast(bases), "part")
        .select("doc_ids", "sizes", "codes", (F.col("base") + F.col("before")).alias("start"))
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def op5_dac_tokens(docs: DataFrame) -> DataFrame:
    """Writes the files with the public 49k word vocabulary and end id 2, and reads them back.

    Null and empty texts have the end id only; rows that repeat follow each
    other, a null doc_id comes first, and other columns are ignored. An empty
    table gives no rows. A text of any length lies within one shard.
    """
    import public_tokenizers

    path = new_path(docs.sparkSession, "dac-tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_tokens(docs.sparkSession, path)
