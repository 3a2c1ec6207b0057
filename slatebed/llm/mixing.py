"""Mixing sources to target weights by entropy balancing.

Every source has a target of words. Among all document rates w that reach the
targets and are at most ``MOST_COPIES``, the ones nearest to one each (in
relative entropy) are ``min(MOST_COPIES, exp(t * size / mean size))`` with one
dual variable t a source. Newton steps on the convex dual find t; a step is one
aggregation over the counts of documents by source and size, held to an
interval that is known to contain the root. The rates are then rounded to
whole copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatebed.llm.common import forget, numbered, scratch, small, stored, text_or_empty, unpacked, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_COPIES = 1.5, 2
STEPS, TOLERANCE = 40, 1e-4
#: Rates are whole multiples of 1/ONE, and sums of them exact, so reruns agree.
ONE = 1 << 20
#: Documents of a source are rounded in groups of about so many.
GROUP = 8192
FEW_SOURCES = 100_000


def document_sizes(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``row, uid, doc_id, source, size`` of every row, stored; a null text has size 0."""
    return numbered(docs, carried, ["doc_id", "source", F.size(words(text_or_empty())).cast("long").alias("size")])


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, n_docs, target``.

    Sources in the order of their code points, null last, weigh 5, 2, 1 and so
    on. The level at which the targets min(2 * source_size, level * weight) add
    up to 150 % of all words is read off the sources in the order in which
    they reach their limit. It is a table of sources, not of documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(float(MOST_COPIES)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", left / weight_left)
    # taking off a source that reaches its limit raises the level, one that doesn't lowers it
    level = F.max("level").over(everything)
    return levels.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select(
        "source", "source_size", "n_docs", "target"
    )


def _rate(size, mean, t):
    """The rate in units of 1/ONE, at most MOST_COPIES."""
    power = F.least(t * size / mean, F.lit(1.0))  # exp(1) is over the limit
    return F.floor(F.least(F.exp(power), F.lit(float(MOST_COPIES))) * ONE).cast("long")


def dual_variables(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, mean, t``: the tilt of each source with words, null if all documents take the limit."""
    spark = sizes.sparkSession
    counts = stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    state = stored(
        targets.where("source_size > 0").select(
            "source",
            "target",
            (F.col("source_size") / F.col("n_docs")).alias("mean"),
            F.lit(0.0).alias("t"),
            F.lit(-700.0).alias("low"),
            F.lit(700.0).alias("high"),
            (F.col("target") >= MOST_COPIES * F.col("source_size") * (1 - TOLERANCE)).alias("done"),
        ),
        "dual",
    )
    for _ in range(STEPS):
        c, s = counts.alias("c"), small(state.where("not done"), FEW_SOURCES).alias("s")
        rate = _rate(F.col("c.size"), F.col("s.mean"), F.col("s.t"))
        tokens = F.col("n") * F.col("c.size")
        sums = (
            c.join(s, F.col("c.source").eqNullSafe(F.col("s.source")))
            .select(
                F.col("c.source").alias("source"),
                (tokens.cast("decimal(28,0)") * rate.cast("decimal(10,0)")).alias("got"),
                F.when(
                    rate < MOST_COPIES * ONE,
                    tokens.cast("decimal(28,0)") * F.floor(rate * F.col("c.size") / F.col("s.mean")).cast("decimal(18,0)"),
                ).otherwise(0).cast("decimal(38,0)").alias("slope"),
            )
            .groupBy("source")
            .agg((F.sum("got").cast("double") / ONE).alias("got"), (F.sum("slope").cast("double") / ONE).alias("slope"))
        )
        s = state.alias("s")
        off = F.col("got") - F.col("target")
        near = s.join(small(sums, FEW_SOURCES).alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left").select(
            "s.*", off.alias("off"), "slope"
        )
        low = F.when(F.col("off") < 0, F.col("t")).otherwise(F.col("low"))
        high = F.when(F.col("off") > 0, F.col("t")).otherwise(F.col("high"))
        step = near.withColumn("low", low).withColumn("high", high).withColumn("newton", F.col("t") - F.try_divide("off", "slope"))
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        # without a usable step: half way, or twice as far while one side is still open
        fallback = (
            F.when(F.col("high") >= 700, F.greatest(F.col("t") * 2, F.col("t") + 1))
            .when(F.col("low") <= -700, F.least(F.col("t") * 2, F.col("t") - 1))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        done = F.col("done") | F.col("off").isNull() | (F.abs("off") <= TOLERANCE * F.col("target"))
        new = stored(
            step.select(
                "source",
                "target",
                "mean",
                F.when(done, F.col("t")).when(inside, F.col("newton")).otherwise(fallback).alias("t"),
                "low",
                "high",
                done.alias("done"),
            ),
            "dual",
        )
        forget(spark, state)
        state = new
        if state.where("not done").isEmpty():
            break
    full = F.col("target") >= F.lit(float(MOST_COPIES)) * F.col("mean") * F.col("n_docs") * (1 - TOLERANCE)
    found = state.join(targets.select(F.col("source").alias("name"), "n_docs"), F.col("source").eqNullSafe(F.col("name")))
    return stored(found.select("source", "mean", F.when(~full, F.col("t")).alias("t")), "tilts")


def mix(sizes: DataFrame) -> DataFrame:
    """``uid, doc_id, source, size, source_size, target, rate, copies`` for rows of :func:`document_sizes`.

    Rates are rounded within groups of a source, largest documents first, so
    that the copies of any number of first documents add up to their rates to
    within a half, and what a group takes differs from its share by less than
    one document. One document a source then takes one copy more or less, the
    one that brings the sum nearest to the target. Documents without words, and
    sources of nothing else, take one copy and no words. Rows that repeat a
    doc_id are documents of their own.
    """
    sizes = sizes.select("uid", "doc_id", "source", "size")
    targets = stored(source_targets(sizes), "targets")
    with scratch(sizes.sparkSession) as stay:
        tilts = dual_variables(sizes, targets)
        stay.append(tilts)
    d, s = sizes.alias("d"), small(targets, FEW_SOURCES).alias("s")
    about = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.n_docs", "s.target")
    t = small(tilts, FEW_SOURCES).alias("t")
    rated = about.alias("a").join(t, F.col("a.source").eqNullSafe(F.col("t.source")), "left").select(
        "a.*",
        F.when(F.col("a.size") == 0, F.lit(ONE))
        .when(F.col("t.t").isNull(), F.lit(MOST_COPIES * ONE))
        .otherwise(_rate(F.col("a.size"), F.col("t.mean"), F.col("t.t")))
        .cast("long")
        .alias("rate"),
    )
    # rows that repeat a doc_id are spread by their size, and are alike where that is the same
    lot = F.xxhash64("doc_id", "size")
    grouped = rated.withColumn("lot", lot).withColumn("group", F.pmod(F.xxhash64("doc_id", "size", F.lit(1)), F.ceil(F.col("n_docs") / GROUP)))
    part = F.pmod("rate", F.lit(ONE))
    seen = F.sum(part).over(
        Window.partitionBy("source", "group").orderBy(F.desc("size"), "lot", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, 0)
    )
    half = F.lit(ONE // 2)
    copies = F.floor(F.col("rate") / ONE) + F.floor((F.col("seen") + half) / ONE) - F.floor((F.col("seen") - part + half) / ONE)
    rounded = stored(
        grouped.withColumn("seen", seen)
        .withColumn("copies", copies.cast("long"))
        .select("uid", "doc_id", "source", "size", "source_size", "target", "rate", "copies"),
        "rounded",
    )
    sums = rounded.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"))
    gap = sums.select("source", (F.col("target") - F.col("taken")).alias("gap"))
    r, g = rounded.alias("r"), small(gap, FEW_SOURCES).alias("g")
    can = F.when(F.col("gap") > 0, F.col("copies") < MOST_COPIES).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
    miss = F.abs(F.abs("gap") - F.col("size"))
    nudge = (
        r.join(g, F.col("r.source").eqNullSafe(F.col("g.source")))
        .where(can & (miss < F.abs("gap")))
        .groupBy("r.source")
        .agg(F.min(F.struct(miss.alias("miss"), F.col("doc_id"), F.col("uid"), F.signum("gap").cast("long").alias("by"))).alias("best"))
        .select("best.uid", "best.by")
    )
    return rounded.join(small(stored(nudge, "nudge"), FEW_SOURCES), "uid", "left").select(
        "uid",
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("rate") / ONE).alias("rate"),
        F.greatest(F.lit(0), F.least(F.lit(MOST_COPIES), F.col("copies") + F.coalesce("by", F.lit(0)))).cast("long").alias("copies"),
    )


def op9_entropy_mix(docs: DataFrame) -> DataFrame:
    """The contract's columns, the rate and the copies of each row.

    Null texts have size 0 and take nothing; a null source is the last of the
    sources; rows that repeat are rows of their own; other columns are ignored.
    An empty table gives no rows.
    """
    return mix(document_sizes(docs, ["doc_id"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies"
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows as often as the mix takes each, columns as they came.

    Null and blank texts have no size and come once; a null source is the last
    of the sources; rows that repeat are each taken for themselves, and of equal
    sizes those first that :func:`mix` ranks first, the same ones on every run.
    """
    sizes = document_sizes(docs, docs.columns)
    copies = mix(sizes).where("copies > 0").select("uid", "copies")
    times = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("time")
    return unpacked(sizes.select("row", "uid").join(copies, "uid").select("row", times), docs.columns)
