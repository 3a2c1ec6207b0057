"""SimHash near-duplicates, filtered by the pigeonring principle.

A fingerprint has 64 bits over word shingles. Two fingerprints that differ in
at most ``TAU`` bits, cut into ``SEGMENTS`` segments on a ring, have a start
from which every chain of l consecutive segments differs in at most
``floor(l * TAU / SEGMENTS)`` bits. With 8 segments and 2 bits that is 0 for
l = 1..3, 1 for l = 4..7 and 2 for l = 8. So the first three segments agree,
and of the next four at most one bit differs, which leaves the first two or
the last two of them alike: 40 bits that agree exactly and serve as the key of
an equi-join. The chain condition is then checked whole, then the distance.

Two bits find close copies. For texts that share a given part of their
shingles, the ring is laid over the shingles themselves: their hashes fall
into segments, the differences of all segments together are bounded by the
similarity, so some segment of texts that are alike enough has no difference
at all, but for rare luck. Equal segments are keys, candidates are checked by
the distance of the fingerprints and then by their shingles. Texts of few
shingles have few segments and would need luck; their keys are the least
hashes of which two such texts have one in common for certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatebed.llm.common import numbered, scratch, small, stored, text_or_empty, unpacked
from slatebed.llm.components import connected_components

TAU, SEGMENTS, WIDTH = 2, 8, 8
SHINGLE_WORDS, SEED = 3, 42
#: Fingerprints that share one key beyond this count are linked through their
#: common neighbours at distance one instead of pair by pair; no link is lost.
CROWDED = 48
#: Texts that share one key of the stage of near copies beyond this count are each paired with a centre only. It is
#: small, so that what is done for a text hardly depends on how many are like it.
STARRED = 4
#: Stage of near copies: words of a shingle, shared part of all shingles of two texts.
NEAR_WORDS, NEAR = 5, 0.8
#: Bits in which longer texts of that similarity may differ: the expected 9.7 and five standard deviations.
NEAR_BITS = 24
#: Texts of so many shingles are short: they are keyed without luck, and their bits aren't looked at.
SHORT = 64
#: Shingles of a segment of the ring, about, and segments of a text that serve as keys.
SEGMENT_SHINGLES, RING = 3, 64
#: Rounds of stars among the members of crowded keys; in the last one what is left is compared whole.
ROUNDS = 4
#: Blocks in which the pairs of a crowded key are made.
BLOCKS = 32
#: Losers up to which they are broadcast; beyond, rows and losers are joined by a shuffle.
FEW_ROWS = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SLICE = 1 << 16


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each word shingle of a text, repeats included."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return []
    digest = xxhash.xxh64_intdigest
    if len(found) < size:
        return [digest(b" ".join(found), SEED)]
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(line[i:j], SEED) for i, j in zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist())]


def majority_bits(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for no hash."""
    total = np.zeros(64, np.int64)
    values = np.array(hashes, dtype=">u8")
    for at in range(0, len(values), _SLICE):
        part = values[at : at + _SLICE]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(values)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        out = np.fromiter((majority_bits(shingle_hashes(t.as_py())) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, fp the 64 bits as a signed long; null texts are empty."""
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        _fingerprint_batches, "doc_id long, fp long"
    )


def _ring(fp: Column, start: int) -> Column:
    """The fingerprint turned so that segment ``start`` comes first."""
    turn = start * WIDTH
    return fp if not turn else F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn))


def ring_keys(fp: Column) -> Column:
    """The 16 exact keys of a fingerprint: start, which half, 40 bits."""
    keys = []
    for start in range(SEGMENTS):
        turned = _ring(fp, start)
        head = F.shiftleft(F.shiftrightunsigned(turned, 40), 16)
        for half, drop in enumerate((24, 8)):
            tail = F.shiftrightunsigned(turned, drop).bitwiseAND(F.lit(0xFFFF))
            keys.append(head.bitwiseOR(tail).bitwiseOR(F.lit((2 * start + half) << 40)))
    return F.array(*keys)


def chain_holds(a: Column, b: Column, start: Column) -> Column:
    """Every chain from ``start`` stays within its share of the budget."""
    diff = a.bitwiseXOR(b)
    cases = F.lit(False)
    for s in range(SEGMENTS):
        turned = _ring(diff, s)
        kept = F.lit(True)
        for length in range(1, SEGMENTS + 1):
            bits = F.bit_count(F.shiftrightunsigned(turned, 64 - length * WIDTH) if length < SEGMENTS else turned)
            kept = kept & (bits <= length * TAU // SEGMENTS)
        cases = F.when(start == s, kept).otherwise(cases)
    return cases


def links(classes: DataFrame) -> DataFrame:
    """``classes(fp, ...)`` of distinct fingerprints to links ``(a, b)``.

    The links join exactly what is joined by differences of at most ``TAU``
    bits: pairs themselves for ordinary keys, and stars over common neighbours
    for crowded ones, where a pair would be one of too many.
    """
    keyed = classes.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    few = stored(keyed.join(sizes.where(F.col("n") <= CROWDED), "key").select("key", "fp"), "ring")
    a, b = few.alias("a"), few.alias("b")
    start = F.shiftrightunsigned(F.col("a.key"), 41)
    pairs = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & chain_holds(F.col("a.fp"), F.col("b.fp"), start)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= TAU),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowded = keyed.join(sizes.where(F.col("n") > CROWDED), "key").select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)))
    around = crowded.select("fp", F.explode(near).alias("centre"))
    stars = (
        around.groupBy("centre")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # 65 at most: a ball of radius one
        .where(F.size("fps") > 1)
        .select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    )
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    component_id is the smallest doc_id that can be reached over fingerprints
    that differ in at most two bits. Equal fingerprints, also those of empty
    and null texts (zero), are one class from the start. Rows that repeat a
    doc_id keep a row each; a null doc_id links like any other, and names a
    component only if that has no other. Extra columns are ignored.
    """
    each = stored(fingerprints(docs), "fingerprints")
    classes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = links(classes.select("fp"))
    groups = connected_components(found)
    joined = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "component").select("fp", "component_id")
    return each.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op8_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint as 16 hex digits, component_id.

    Null and empty texts have fingerprint zero and link like any other; an
    empty table gives no rows; rows that repeat are rows of their own.
    """
    return simhash_components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# -- near copies by their shared shingles


def ring_segments(shingles: np.ndarray) -> np.ndarray:
    """Keys of sorted distinct hashes: one for each of the first segments of the ring that has two or more.

    The number of segments is a power of two near the number of shingles over
    SEGMENT_SHINGLES. Texts of similar size may fall on both sides of a power,
    so those near one have the keys of both. At a similarity of NEAR a segment
    is equal in three of ten cases at least, so texts of over SHORT shingles
    have none in common with a probability under 0.7 ** 32.
    """
    n = len(shingles)
    keys = [_least_hashes(shingles)] if n <= SHORT / NEAR else []
    if n > SHORT:
        mixed = shingles * _ODD
        mixed ^= mixed >> np.uint64(29)
        mixed *= _ODD
        for bits in sorted({max(0, int(m / SEGMENT_SHINGLES)).bit_length() for m in (n, n / NEAR)}):
            edge = n if (1 << bits) <= RING else int(np.searchsorted(shingles, np.uint64(RING << (64 - bits))))
            if not edge:
                continue
            segment = shingles[:edge] >> np.uint64(64 - bits)
            first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            size = np.diff(np.append(first, edge))
            name = (segment[first] + np.uint64(bits << 32)) * _ODD
            keys.append((np.add.reduceat(mixed[:edge], first) ^ name)[size > 1])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _least_hashes(shingles: np.ndarray) -> np.ndarray:
    """Of sorted distinct hashes so many that a text which shares NEAR of them has one among its own.

    A text shares at least ``ceil(NEAR * n)`` of its n shingles with any that is
    so similar, so it can miss the others only; the least shared one is then
    among the first of both.
    """
    n = len(shingles)
    return (shingles[: n - -(-4 * n // 5) + 1] ^ _ODD) * _ODD if n else shingles


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint, digest and number of the distinct shingles, and ring keys of each text."""
    for batch in batches:
        fps, digests, counts, keys = [], [], [], []
        for text in batch.column(1):
            hashes = shingle_hashes(text.as_py(), NEAR_WORDS)
            distinct = np.unique(np.array(hashes, np.uint64))
            fps.append(majority_bits(hashes))
            digests.append(xxhash.xxh3_128_digest(distinct.tobytes()))
            counts.append(len(distinct))
            keys.append(ring_segments(distinct).view(np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
        columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), lists]
        yield pa.RecordBatch.from_arrays(columns, ["uid", "fp", "digest", "n", "keys"])


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            found = [np.unique(np.array(shingle_hashes(t.as_py(), NEAR_WORDS), np.uint64)).view(np.int64) for t in some.column(1)]
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in found])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([some.column(0), lists], ["uid", "shingles"])


def _shared_keys(classes: DataFrame) -> DataFrame:
    """``key, uid, n`` of the keys that n classes have, n over one."""
    keyed = classes.select("uid", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return stored(keyed.join(sizes, "key").select("key", "uid", "n"), "shared")


def _stars(shared: DataFrame) -> DataFrame:
    """``x, y``: each member y of a crowded key and the one that shares its segments with most others."""
    crowd = shared.where(F.col("n") > STARRED)
    known = crowd.join(shared.groupBy("uid").agg(F.sum("n").alias("known")), "uid")
    centres = known.groupBy("key").agg(F.max(F.struct("known", -F.col("uid"))).alias("c")).select("key", (-F.col("c.col2")).alias("x"))
    return crowd.join(centres, "key").where("uid <> x").select("x", F.col("uid").alias("y")).distinct()


def near_candidates(classes: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """``classes(uid, fp, keys)`` to candidate pairs ``a < b`` of uids.

    They come from fingerprints within two bits and from equal segments of the
    ring. Within an ordinary key every pair is one. The members of a crowded key
    are paired with the one that shares its segments with most others, which in
    a crowd of copies is the text that they were made from; what is not
    connected by then is left to :func:`crowd_links`.
    """
    shared = shared or _shared_keys(classes)
    by_fp = stored(classes.groupBy("fp").agg(F.min("uid").alias("rep")), "fps")
    found = links(by_fp.select("fp"))
    a, b = by_fp.select(F.col("fp").alias("a"), F.col("rep").alias("x")), by_fp.select(F.col("fp").alias("b"), F.col("rep").alias("y"))
    close = found.join(a, "a").join(b, "b").select("x", "y")
    same = classes.join(by_fp, "fp").where("uid <> rep").select(F.col("rep").alias("x"), F.col("uid").alias("y"))
    few = shared.where(F.col("n") <= STARRED)
    ring = few.alias("p").join(few.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.uid") < F.col("q.uid"))).select(
        F.col("p.uid").alias("x"), F.col("q.uid").alias("y")
    )
    every = close.union(same).union(ring).union(_stars(shared))
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _alike(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that share at least NEAR of all their shingles."""
    both = pairs.select("a", "b").join(shingles.select(F.col("uid").alias("a"), F.col("shingles").alias("sa")), "a").join(
        shingles.select(F.col("uid").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(5 * shared >= 4 * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _differences(stars: DataFrame, shingles: DataFrame, groups: DataFrame) -> DataFrame:
    """``x, y, n, component, linked, d, diff`` of the stars whose members aren't all connected yet.

    diff has the d shingles that only one of x and y has, n is the number of y's.
    """
    part = lambda uid, name: groups.select(F.col("node").alias(uid), F.col("component").alias(name))
    named = stars.join(part("y", "cy"), "y", "left").join(part("x", "cx"), "x", "left")
    named = named.select("x", "y", F.coalesce("cy", "y").alias("component"), F.coalesce("cx", "x").alias("cx"))
    # a star is read again by its centre, so what is known of its members is written down
    named = stored(named, "stars")
    open_stars = named.where("component <> cx").select("x").distinct()
    both = (
        named.join(open_stars, "x", "left_semi")
        .join(shingles.select(F.col("uid").alias("y"), F.col("shingles").alias("sy")), "y")
        .join(shingles.select(F.col("uid").alias("x"), F.col("shingles").alias("sx")), "x")
        .withColumns({"own": F.array_except("sy", "sx"), "gone": F.array_except("sx", "sy")})
    )
    same, every = F.size("sy") - F.size("own"), F.size("sx") + F.size("own")
    diff = F.concat("own", "gone")
    linked = (5 * same >= 4 * every).alias("linked")
    return both.select("x", "y", F.size("sy").alias("n"), "component", linked, F.size(diff).alias("d"), diff.alias("diff"))


def crowd_links(stars: DataFrame, shingles: DataFrame, links: DataFrame) -> DataFrame:
    """``links(a, b)`` and what is missing among them between the members of each star.

    Let x be the centre of a star and D(y) the shingles that only one of x and
    y has. Two members with nothing in common in their D have at most the
    likeness of each to x: what both have, x has, and what x or one of them has,
    one of both has. So two that are alike are both linked to x, or their D
    have a shingle in common. As texts y and z that are alike differ by at most
    n(y) / 4 shingles, it is among the first n(y) / 4 + 1 of D(y), in any order
    that is the same for all of a star, and likewise for z. The rare ones come
    first; those are keys. All of D that comes before the first common one are
    differences, so one at place i is of use only if some text has it at a place
    up to n(y) / 4 - i. Keys that would make too many pairs between parts that
    aren't connected yet are stars of the next round; in the last round all
    their pairs are made, a block at a time.
    """
    for last in (*[False] * (ROUNDS - 1), True):
        told = stored(_differences(stars, shingles, connected_components(links)), "differences")
        told_by = ["x", "y", "n", "component", "linked", "d"]
        entries = told.select(*told_by, F.explode("diff").alias("e"))
        weights = entries.groupBy("x", "e").agg(F.count("*").alias("m"), (F.min("component") != F.max("component")).alias("open"))
        first = F.slice(F.sort_array(F.collect_list(F.struct("open", "m", "e"))), F.lit(1), F.floor(F.col("n") / 4).cast("int") + 1)
        prefixes = entries.join(weights, ["x", "e"]).groupBy(*told_by).agg(first.alias("first"))
        placed = F.transform("first", lambda f, i: F.struct(f.open.alias("open"), f.e.alias("e"), i.alias("at")))
        keyed = prefixes.select(*told_by, F.explode(F.filter(placed, lambda f: f.open)).alias("f")).select(*told_by, "f.e", "f.at")
        keyed = stored(keyed, "placed")
        keyed = keyed.join(keyed.groupBy("x", "e").agg(F.min("at").alias("least")), ["x", "e"])
        keyed = stored(keyed.where(4 * (F.col("at") + F.col("least")) <= F.col("n")).drop("least"), "keyed")
        parts = keyed.groupBy("x", "e", "component").agg(F.count("*").alias("k"))
        sizes = parts.groupBy("x", "e").agg(F.sum("k").alias("t"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"))
        dealt = stored(keyed.join(sizes.where("pairs > 0"), ["x", "e"]).withColumn("many", F.col("pairs") > CROWDED * F.col("t")), "dealt")
        pairs = _between(dealt.where("not many"), 1)
        many = dealt.where("many")
        if last:
            pairs = pairs.union(_between(many, BLOCKS))
        alike = _alike(stored(pairs.distinct(), "crowd_pairs"), shingles)
        links = stored(links.union(told.where("linked").select("x", "y")).union(alike), "near")
        if last or many.isEmpty():
            return links
        known = many.join(many.groupBy("y").agg(F.sum("t").alias("known")), "y")
        # one that the last centre is not linked to
        centres = known.groupBy("x", "e").agg(F.max(F.struct(~F.col("linked"), "known", -F.col("y"))).alias("c"))
        centres = centres.select("x", "e", (-F.col("c.col3")).alias("centre"))
        stars = stored(many.join(centres, ["x", "e"]).where("y <> centre").select(F.col("centre").alias("x"), "y").distinct(), "next_stars")


def _between(keyed: DataFrame, blocks: int) -> DataFrame:
    """Pairs ``a < b`` in different components that may be alike and have a key ``x, e`` in common.

    Texts that are alike differ by at most a ninth of the sum of their sizes. If
    e is the first that they have in common, all keys before it are differences,
    and so is what one has more of from there on.
    """
    p = keyed.withColumn("block", F.pmod(F.xxhash64("y"), F.lit(blocks)).cast("int")).alias("p")
    q = keyed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).alias("q")
    same = (F.col("p.x") == F.col("q.x")) & (F.col("p.e") == F.col("q.e")) & (F.col("p.block") == F.col("q.block"))
    fit = 5 * F.least("p.n", "q.n") >= 4 * F.greatest("p.n", "q.n")
    apart = (F.col("p.y") < F.col("q.y")) & (F.col("p.component") != F.col("q.component"))
    rest = F.abs(F.col("p.d") - F.col("p.at") - F.col("q.d") + F.col("q.at"))
    near = 9 * (F.col("p.at") + F.col("q.at") + rest) <= F.col("p.n") + F.col("q.n")
    return p.join(q, same & apart & fit & near).select(F.col("p.y").alias("a"), F.col("q.y").alias("b"))


def near_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes ``a, b`` that connect all whose texts share at least NEAR of all their shingles."""
    about = classes.select("uid", "fp", "n")
    shared = _shared_keys(classes)
    stars = stored(_stars(shared), "stars")
    pairs = (
        near_candidates(classes, shared)
        .join(about.select(F.col("uid").alias("a"), F.col("fp").alias("fa"), F.col("n").alias("na")), "a")
        .join(about.select(F.col("uid").alias("b"), F.col("fp").alias("fb"), F.col("n").alias("nb")), "b")
        .where((F.least("na", "nb") <= SHORT) | (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= NEAR_BITS))
        .where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
    )
    pairs = stored(pairs.select("a", "b"), "pairs")
    ends = [pairs.select(F.col("a").alias("uid")), pairs.select(F.col("b").alias("uid"))]
    ends += [stars.select(F.col("x").alias("uid")), stars.select(F.col("y").alias("uid"))]
    wanted = ends[0].union(ends[1]).union(ends[2]).union(ends[3]).distinct()
    texts = rows.join(small(stored(wanted, "wanted"), FEW_ROWS), "uid", "left_semi").select("uid", F.coalesce("row.text", F.lit("")).alias("text"))
    shingles = stored(texts.mapInArrow(_shingle_batches, "uid long, shingles array<long>"), "shingles")
    found = stored(_alike(pairs, shingles), "alike")
    return found if stars.isEmpty() else crowd_links(stars, shingles, found)


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, uid`` of every row and ``uid, kept`` of it.

    Rows whose texts have the same five-word shingles, A-Z lowered, are one
    class; classes that share 0.8 of their shingles are linked; of each
    connected group the row with the smallest doc_id is kept, the null ones
    last. Texts of fewer words are one shingle, null, empty and blank ones have
    none and are one class. Equal rows are told apart, so one of them stays.
    """
    rows = numbered(docs, docs.columns, [])
    with scratch(docs.sparkSession) as stay:
        kept = _kept_rows(rows)
        stay.append(kept)
    return rows, kept


def _kept_rows(rows: DataFrame) -> DataFrame:
    told = rows.select("uid", F.coalesce("row.text", F.lit("")).alias("text")).mapInArrow(
        _near_batches, "uid long, fp long, digest binary, n long, keys array<long>"
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    each = stored(told, "fingerprints")
    ids = rows.select("uid", F.col("row.doc_id").alias("doc_id"))
    of_row = stored(each.select("uid", "digest").join(ids, "uid").select("digest", order.alias("first")), "rows")
    best = of_row.groupBy("digest").agg(F.min("first").alias("first"))
    with scratch(rows.sparkSession) as stay:
        classes = stored(each.join(best.select(F.col("first.uid").alias("uid")), "uid", "left_semi").select("uid", "fp", "n", "keys"), "classes")
        links = near_links(rows, classes)
        stay.append(links)
    groups = connected_components(links)
    # the least row of each group of classes
    grouped = best.join(groups, F.col("first.uid") == F.col("node"), "left").select("digest", "first", F.coalesce("component", "first.uid").alias("component"))
    heads = grouped.groupBy("component").agg(F.min("first").alias("head"))
    named = grouped.join(heads, "component").select("digest", "head")
    kept = of_row.join(named, "digest").select("first.uid", (F.col("first.uid") == F.col("head.uid")).alias("kept"))
    return stored(kept, "kept")


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, columns as they came; see :func:`near_duplicates`."""
    rows, kept = near_duplicates(docs)
    gone = small(kept.where("not kept").select("uid"), FEW_ROWS)
    return unpacked(rows.join(gone, "uid", "left_anti"), docs.columns)
