"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms whose share of documents lies in a band, so common
words and one-off strings say nothing. Fixed random subsets are drawn from it,
SETS of every density from a half down to 2 ** -DENSITIES of its terms, the
same for all documents. A document's distinct terms of a subset are sorted and
hashed, and the hashes of all subsets are its fingerprint; a subset without a
term of the document has dashes. Equal texts agree in all subsets. Texts that
share a part of their terms agree in sparse ones, where they have few terms,
and short and long texts each find densities that suit them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatebed.llm.common import small, stored, text_or_empty, words

#: Shares of documents with a term, in (0, 1): at least, at most. The first
#: bounds the lexicon: it has at most (mean distinct terms) / LEAST terms,
#: however many documents there are.
LEAST, MOST = 0.001, 0.02
DENSITIES, SETS, HASH_DIGITS = 12, 5, 5
SUBSETS = DENSITIES * SETS
NONE = "-" * HASH_DIGITS
#: A lexicon of so many terms is broadcast; a larger one is joined by a shuffle.
MOST_TERMS = 500_000
#: Quantiles of doc_id, bytes of text of a bucket of neighbours, and buckets up to which their first rows are broadcast.
KNOTS, BUCKET_BYTES, FEW_BUCKETS = 1024, 1 << 23, 1_000_000


def terms(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def _fixed(values) -> Column:
    """An array of whole numbers that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def subset_mask(term: Column) -> Column:
    """A bit for each subset that the term is in, by three digits of an MD5 for each."""
    limits, bits = _fixed(4096 >> (k // SETS + 1) for k in range(SUBSETS)), _fixed(1 << k for k in range(SUBSETS))

    def step(mask, k):
        value = F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(":"), term).cast("binary")), 1, 3), 16, 10).cast("long")
        return mask + F.when(value < F.get(limits, k), F.get(bits, k)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), F.lit(0).cast("long"), step)


def lexicon(docs: DataFrame) -> DataFrame:
    """``term, mask`` of the terms of the band that some subset has."""
    n = docs.count()
    counts = docs.select(F.explode(terms(text_or_empty())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = counts.where(F.col("df").between(max(2, math.ceil(LEAST * n)), max(2, math.floor(MOST * n)))).select("term")
    # written down, as a filter on the mask would be carried down to every single term
    return stored(band, "band").select("term", subset_mask(F.col("term")).alias("mask")).where("mask <> 0")


def _hashes(known: Column, plain: Column) -> Column:
    """One hash for each subset; ``plain`` in all places where no subset has a term."""
    inside = lambda bit: F.transform(F.filter(known, lambda e: e["mask"].bitwiseAND(bit) != 0), lambda e: e["term"])
    chosen = F.transform(_fixed(1 << k for k in range(SUBSETS)), lambda bit: F.array_join(inside(bit), " "))
    hashes = F.transform(chosen, lambda c: F.when(c == "", NONE).otherwise(F.substring(F.md5(c.cast("binary")), 1, HASH_DIGITS)))
    return F.when(F.size(known) > 0, hashes).otherwise(F.array_repeat(plain, SUBSETS))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets in which two fingerprints agree, of those in which one has a term."""
    count = lambda test: F.aggregate(F.zip_with(a, b, lambda x, y: test(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    same, either = count(lambda x, y: (x == y) & (x != NONE)), count(lambda x, y: (x != NONE) | (y != NONE))
    return same.cast("double") / either


def fingerprints(rows: DataFrame, keys: list[str], texts: dict[str, str], carried: list[str], lex: DataFrame) -> DataFrame:
    """``keys``, ``carried`` and, for each text column, an array of hashes under its new name.

    Terms meet the lexicon in a join and are gathered again by ``keys``, which
    have to name one row each. Rows that lie together by the first key stay
    where they are. Each text also has the term "", which the lexicon knows, so
    no row is lost and one row of it carries what else is needed.
    """
    sides = [
        F.struct(
            F.lit(i).alias("side"),
            F.concat(F.array(F.lit("")), terms(F.col(text))).alias("terms"),
            F.substring(F.md5(F.col(text).cast("binary")), 1, HASH_DIGITS).alias("plain"),
            F.when(F.lit(i == 0), F.struct(*carried)).alias("carried"),
        )
        for i, text in enumerate(texts)
    ]
    each = rows.select(*keys, F.explode(F.array(*sides)).alias("s")).select(
        *keys, "s.side", "s.carried", "s.plain", F.explode("s.terms").alias("term")
    )
    first = F.col("term") == ""
    slim = each.select(*keys, "side", "term", F.when(first, F.col("carried")).alias("carried"), F.when(first, F.col("plain")).alias("plain"))
    every = lex.union(lex.sparkSession.sql("select '' term, 0L mask"))
    met = slim.join(small(every, MOST_TERMS), "term")
    entry = F.struct("term", "mask")
    gathered = met.groupBy(*keys).agg(
        F.max("carried").alias("carried"),
        *(F.max(F.when(F.col("side") == i, F.col("plain"))).alias(f"_plain{i}") for i in range(len(texts))),
        *(F.collect_list(F.when((F.col("side") == i) & (F.col("term") != ""), entry)).alias(f"_known{i}") for i in range(len(texts))),
    )
    ordered = gathered.select(*keys, "carried", *(f"_plain{i}" for i in range(len(texts))), *(F.array_sort(f"_known{i}").alias(f"_known{i}") for i in range(len(texts))))
    return ordered.select(
        *keys,
        *(F.col(f"carried.{c}").alias(c) for c in carried),
        *(_hashes(F.col(f"_known{i}"), F.col(f"_plain{i}")).alias(new) for i, new in enumerate(texts.values())),
    )


def neighbour_buckets(rows: DataFrame) -> Column:
    """A bucket number of ``rows(doc_id, text, tie)`` that never falls in the order of doc_id and tie, null ids first.

    Quantiles of doc_id part the rows, and each part is divided evenly so that
    a bucket has about BUCKET_BYTES of text. An id that fills whole quantiles,
    and the rows without one, are divided by their ties.
    """
    fractions = [i / KNOTS for i in range(KNOTS + 1)]
    about = rows.agg(
        F.percentile_approx("doc_id", fractions, 20 * KNOTS).alias("knots"),
        F.sum(F.octet_length("text")).alias("bytes"),
        F.count("*").alias("n"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    found = about["knots"] or [0]
    knots = sorted(set(found))
    each = max(1, math.ceil((about["bytes"] or 0) / (KNOTS * BUCKET_BYTES)))
    crowd = [each * found.count(k) if found.count(k) > 1 else 0 for k in knots]
    nulls = max(1, math.ceil(KNOTS * each * about["nulls"] / max(1, about["n"])))
    values, widths = _fixed(knots), _fixed([max(1, b - a) for a, b in zip(knots, knots[1:])] + [1])
    steps = _fixed(1 << i for i in range(len(knots).bit_length() - 1, -1, -1))
    doc_id = F.col("doc_id")

    def ahead(at, step):
        return F.when((at + step < len(knots)) & (F.get(values, at + step) <= doc_id), at + step).otherwise(at)

    at = F.greatest(F.aggregate(steps, F.lit(-1).cast("long"), ahead), F.lit(0).cast("long"))
    share = lambda parts: F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * parts), parts - 1)

    def bucket(at):
        gone = (doc_id - F.get(values, at)).cast("double") * each / F.get(widths, at)
        inner = F.least(F.greatest(F.floor(gone), F.lit(0)), F.lit(each - 1))
        hot = (F.get(_fixed(crowd), at) > 0) & (doc_id == F.get(values, at))
        return F.shiftleft(at, 32) + F.when(hot, share(F.get(_fixed(crowd), at))).otherwise(F.lit(1 << 31) + inner)

    found = F.get(F.transform(F.array(at), bucket), F.lit(0))
    return F.when(doc_id.isNull(), F.lit(-(1 << 32)) + share(F.lit(nulls))).otherwise(found).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``bucket, guest, doc_id, text, tie`` dealt so that windows see the next document.

    The first row of a bucket also comes as a guest, last of the bucket before
    (the very first of the last bucket), so the next row is always in the same
    window. The table of buckets has a row for each BUCKET_BYTES of text or so.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    bucketed = rows.withColumn("bucket", neighbour_buckets(rows))
    firsts = bucketed.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    order = Window.orderBy("bucket")
    before = stored(
        firsts.select(
            "bucket",
            "first",
            F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("host"),
        ),
        "buckets",
    )
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    placed = bucketed.join(small(before, FEW_BUCKETS), "bucket").withColumn(
        "seats", F.when(is_first, F.array(own, F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    )
    return placed.select("doc_id", "text", "tie", F.explode("seats").alias("seat")).select("seat.bucket", "seat.guest", "doc_id", "text", "tie")


def op2_imatch(docs: DataFrame) -> DataFrame:
    """The contract's columns.

    Null texts are empty. Rows that repeat a doc_id follow each other, ordered
    by a hash of the text; null ids come first. A text without a term of any
    subset, an empty one included, has the hash of the whole text in every
    place. An empty table gives no rows; other columns are ignored. The texts
    are shuffled once, by ranges of doc_id; everything after is within that.
    """
    lex = stored(lexicon(docs), "lexicon")
    seat = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = (
        with_next(docs)
        .withColumn("_next", F.coalesce(F.lead("text").over(seat), F.lit("")))
        .withColumn("row", F.row_number().over(seat))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("_next"), F.lit(1), half)))
        .drop("_next")
        .withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    )
    found = fingerprints(
        edited, ["bucket", "row"], {"text": "_fp", "edited": "_edited_fp"}, ["guest", "doc_id", "n_chars", "edited_sha256"], lex
    )
    following = Window.partitionBy("bucket").orderBy("row")
    return (
        found.withColumn("_next_fp", F.lead("_fp").over(following))
        .where(~F.col("guest"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            F.array_join("_fp", "").alias("fingerprint"),
            F.array_join("_edited_fp", "").alias("edited_fingerprint"),
            likeness(F.col("_fp"), F.col("_edited_fp")).alias("near_edited"),
            likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"),
        )
    )
