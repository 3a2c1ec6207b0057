"""Union, deduplication, policy, ranking and credit of candidates.

Input order matters in all of these, so candidates carry an ``ordinal``. A query
may have most of the rows, so ranks are numbered over ranges of the order and
best rows are aggregates; windows are left to groups of copies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatebed.dims import CONTEXT_SAFE, OPEN, provider_dim
from slatebed.functions.license import attribution, is_context_safe, license_rank
from slatebed.functions.urls import normalize_url
from slatebed.functions.values import looks_personal
from slatebed.operators.hashes import hamming_pairs
from slatebed.operators.totals import numbered
from slatebed.sources.shared import written

POLICIES = ("open-only", "context-safe", "safe-only", "prefer-safe", "any")


def resolve_policy(policy: str | None = None, require_safe_license: bool = True) -> str:
    """The old switch only counts where no policy is given."""
    chosen = policy or ("safe-only" if require_safe_license else "any")
    if chosen not in POLICIES:
        raise ValueError(f"unknown license policy: {chosen}")
    return "context-safe" if chosen == "safe-only" else chosen


def union_candidates(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def policy_filter(df: DataFrame, policy: str) -> DataFrame:
    tags = {"open-only": OPEN, "context-safe": CONTEXT_SAFE}.get(resolve_policy(policy))
    return df.where(F.col("license").isin(tags)) if tags else df


def minimum_size(df: DataFrame, width: int = 0, height: int = 0) -> DataFrame:
    """Known dimensions below the minimum go; unknown ones pass."""
    w, h = F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))
    return df.where(~((w > 0) & (w < width)) & ~((h > 0) & (h < height)))


def first_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The row of least ordinal for each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal"))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def dedupe_url(df: DataFrame, best_copy: bool = False) -> DataFrame:
    """One row for each query and normalised URL: the first, or the best-ranked copy."""
    keyed = df.withColumn("_key", normalize_url(F.col("url")))
    if not best_copy:
        return first_by(keyed, "query", "_key").drop("_key")
    place = F.row_number().over(Window.partitionBy("query", "_key").orderBy(*_rank_keys("any")))
    return keyed.withColumn("_place", place).where("_place = 1").drop("_place", "_key")


def _ascending_keys() -> tuple[Column, ...]:
    """License rank, confidence, pixels, filled fields and ordinal; the middle three count from the largest."""
    pixels = F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))
    filled = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("author", "source_page_url", "title")), F.lit(0))
    confidence = F.coalesce("confidence", F.when(is_context_safe(F.col("license")), 0.5).otherwise(0.0))
    return license_rank(F.col("license")), confidence, pixels, filled, F.col("ordinal")


def _rank_keys(policy: str) -> list[Column]:
    rank, confidence, pixels, filled, ordinal = _ascending_keys()
    keys = [rank, confidence.desc(), pixels.desc(), filled.desc(), ordinal]
    return [F.when(rank < 99, 0).otherwise(1), *keys] if policy == "prefer-safe" else keys


def rank_all(df: DataFrame, policy: str = "safe-only", width: int = 0, height: int = 0) -> DataFrame:
    """Filtered rows with ``position`` within the query and ``score`` 1 / position."""
    policy = resolve_policy(policy)
    kept = minimum_size(policy_filter(df, policy), width, height)
    return numbered(kept, ["query"], _rank_keys(policy)).withColumn("score", F.lit(1.0) / F.col("position"))


def _least(policy: str) -> Column:
    """The rank keys as one struct whose least is the best row."""
    keys = _rank_keys(policy)
    split = len(keys) - 5  # prefer-safe has one more in front
    rank, confidence, pixels, filled, ordinal = _ascending_keys()
    return F.struct(*keys[:split], rank, (-confidence).alias("c"), (-pixels).alias("p"), (-filled).alias("f"), ordinal)


def pick_best(df: DataFrame, policy: str = "safe-only", width: int = 0, height: int = 0) -> DataFrame:
    """Each query's first-ranked row, by partial minima and no sort."""
    policy = resolve_policy(policy)
    kept = minimum_size(policy_filter(df, policy), width, height)
    best = kept.groupBy("query").agg(F.min_by(F.struct(*kept.columns), _least(policy)).alias("_best"))
    return best.select("_best.*", F.lit(1).cast("long").alias("position"), F.lit(1.0).alias("score"))


def limit_per_source(df: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query", "source").orderBy("ordinal"))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def with_source_names(df: DataFrame, source: str, name: str) -> DataFrame:
    """Rows with the display name of their source; one that isn't known keeps its id."""
    names = F.broadcast(provider_dim(df.sparkSession).select(F.col("source").alias(source), F.col("pretty").alias("_pretty")))  # 25 rows
    return df.join(names, source, "left").withColumn(name, F.coalesce("_pretty", source)).drop("_pretty")


def enrich(df: DataFrame) -> DataFrame:
    """Fills in the line of credit where there is none."""
    out = with_source_names(df, "source", "_name")
    line = attribution(F.col("license"), F.col("author"), F.col("_name"), F.col("source_page_url"), F.col("title"))
    had = F.col("attribution_line") if "attribution_line" in df.columns else F.lit(None).cast("string")
    return out.withColumn("attribution_line", F.coalesce(had, line)).drop("_name")


def warnings_of(found: DataFrame, queries: DataFrame, policy: str = "safe-only") -> DataFrame:
    """``query, warnings`` of each of ``queries(query, dry_run)``.

    A blank query is told so and nothing else. A dry run finds nothing, so only
    what the query itself calls for is said after it: that it seems to hold
    personal data. Else rows that a browser has found are told of, and a policy
    without limits.
    """
    browsed = found.groupBy("query").agg(F.bool_or(F.col("source") == "browser").alias("_browsed"))
    dry = F.coalesce("dry_run", F.lit(False))
    warnings = F.array(
        F.when(dry, "dry-run"),
        F.when(looks_personal(F.col("query")), "pii"),
        F.when(~dry & F.coalesce("_browsed", F.lit(False)), "browser"),
        F.when(~dry & F.lit(policy == "any"), "any-policy"),
    )
    blank = F.trim(F.coalesce("query", F.lit(""))) == ""
    told = F.when(blank, F.array(F.lit("empty"))).otherwise(F.filter(warnings, lambda w: w.isNotNull()))
    return queries.join(browsed, "query", "left").select("query", told.alias("warnings"))


def new_since(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose URL the query has not shown yet."""
    return current.join(seen.select("query", "url").distinct(), ["query", "url"], "left_anti")


def provider_report(df: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows for each requested source, zero counts kept."""
    counts = df.groupBy("source").agg(F.count("*").alias("n"))
    return requested.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("ok"))


def batch_top(df: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query its count and first-ranked URL; queries without rows stay."""
    kept = policy_filter(df, "safe-only")
    top = kept.groupBy("query").agg(F.count("*").alias("n"), F.min_by("url", _least("safe-only")).alias("top_url"))
    return queries.join(top, "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"), "top_url")


def session_user(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows with the row of another table that they name; those that name none go."""
    return left.join(right, F.col(key) == F.col(other))


def ok_ratio(report: DataFrame) -> DataFrame:
    """How many candidates came from how many of the sources asked."""
    return report.agg(F.sum("n").alias("candidates"), F.count_if("ok").alias("ok"), F.count("*").alias("asked"))


def overlaid(*layers: Column) -> Column:
    """The last of the layers that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in reversed(layers)))


def best_copies(df: DataFrame, most: int = 5, digits: int = 4) -> DataFrame:
    """Rows of which no better near copy is in the same bucket: larger, freer, surer, then a smaller file.

    Buckets are the first hexadecimal digits of the hash, copies are within
    ``most`` bits. Equal hashes are one class, of which the best row stays;
    pairs of classes come from the wide-key lookup, so a bucket may have any
    number of rows. Rows without a hash stay.
    """
    pixels = F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))
    order = F.struct(
        (-pixels).alias("pixels"), license_rank(F.col("license")).alias("rank"), (-F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.coalesce("bytes", F.lit((1 << 63) - 1)).alias("bytes"), F.col("ordinal").alias("ordinal"),
    )
    classes = written(df.where("phash is not null").groupBy(F.lower("phash").alias("phash")).agg(F.min(order).alias("best")), "classes")
    pairs = hamming_pairs(classes, most).where(F.substring("hash_a", 1, digits) == F.substring("hash_b", 1, digits))
    a = classes.select(F.col("phash").alias("hash_a"), F.col("best").alias("best_a"))
    b = classes.select(F.col("phash").alias("hash_b"), F.col("best").alias("best_b"))
    lost = pairs.join(a, "hash_a").join(b, "hash_b").select(F.when(F.col("best_a") < F.col("best_b"), F.col("hash_b")).otherwise(F.col("hash_a")).alias("phash"))
    kept = classes.join(lost, "phash", "left_anti").select("best.ordinal")
    return df.where("phash is null").unionByName(df.where("phash is not null").join(kept, "ordinal", "left_semi").select(df.columns))


def bucket_recall(df: DataFrame, most: int = 5, digits: int = 4) -> DataFrame:
    """How many of the pairs of near hashes lie in one bucket; no pairs, no recall."""
    pairs = hamming_pairs(df, most)
    found = F.count_if(F.substring("hash_a", 1, digits) == F.substring("hash_b", 1, digits))
    return pairs.agg(F.count("*").alias("pairs"), found.alias("found"), F.try_divide(found, F.count("*")).alias("recall"))
