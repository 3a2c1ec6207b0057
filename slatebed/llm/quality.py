"""Quality rules with verdicts by host.

Three rules are counted for each document. For each host and rule the share of
documents that fail is shrunk towards that of all hosts by a beta prior, whose
two parameters come from the hosts' own rates (method of moments). A host is
rejected if some rule's rate is over that rule's limit even at the low end of
its posterior. The limit follows from the prior: SPREADS of its standard
deviations over its mean and TIMES_MEAN times the mean at least, but no more
than HIGHEST. A document that fails the base rules goes by itself; of any other
its host decides, and its own failures of the other rules are evidence for the
host only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatebed.llm.common import small, stored, text_or_empty, unpacked, words

#: A rule's limit for a host: standard deviations of the prior over its mean,
#: times the mean at least, and the share of failing documents that is too many anywhere.
SPREADS, TIMES_MEAN, HIGHEST = 2.0, 2.0, 0.5
#: Standard deviations of a host's posterior that its rate is lowered by before it is held against the limit.
BENEFIT = 1.645
#: The rule against symbols: so many of them to a word.
SYMBOLS_A_WORD = 0.25
#: The rule against repeated lines: so large a share of the lines with a word.
DUP_LINE_SHARE = 0.5
WINDOW_WORDS = 5


#: Hosts up to which their verdicts are broadcast.
FEW_HOSTS = 200_000


def document_rules(docs: DataFrame, host: str = "source", whole_rows: bool = False) -> DataFrame:
    """``doc_id, host`` and the counts of each whole text; nulls count as empty.

    With ``whole_rows`` each comes with its row, as the struct ``row``. Five-word windows are compared by 64-bit hashes of their words' hashes, and
    sorted where a text repeats one: n log n for any text.
    """
    text = F.col("_text")
    kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] * whole_rows
    one = docs.select(*kept, "doc_id", F.col(host).alias("host"), text_or_empty().alias("_text"))
    kept = ["row"] * whole_rows
    two = one.select(
        *kept,
        "doc_id",
        "host",
        words(text).alias("_words"),
        F.length(text).alias("_chars"),
        F.regexp_count(text, F.lit(r"[ \x09-\x0D]")).alias("_gaps"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \x09-\x0D]")).alias("_lines"),
    )
    three = two.select(
        *kept,
        "doc_id",
        "host",
        F.size("_words").alias("_n"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        (F.col("_chars") - F.col("_gaps")).cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    hashes, n = F.col("_hashes"), F.col("_n")
    plain = F.transform(
        F.sequence(F.lit(1), n - (WINDOW_WORDS - 1)),
        lambda i: F.xxhash64(*(F.element_at(hashes, (i + k).cast("int")) for k in range(WINDOW_WORDS))),
    )
    four = three.withColumn("_plain", F.when(n >= WINDOW_WORDS + 1, plain))
    # only texts with a repeated window pay for the sort
    repeats = F.col("_plain").isNotNull() & (F.size(F.array_distinct("_plain")) < F.size("_plain"))
    five = four.withColumn("_repeats", repeats).withColumn(
        "_sorted",
        F.when(
            F.col("_repeats"),
            F.array_sort(F.transform("_plain", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    ordered = F.col("_sorted")
    starts = F.array_sort(
        F.filter(
            F.transform(
                ordered,
                lambda x, j: F.when(
                    ((j > 0) & (F.get(ordered, j - 1)["h"] == x["h"])) | (F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False))),
                    x["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
    )
    six = five.withColumn("_starts", F.when(F.col("_repeats"), starts))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW_WORDS).alias("last")),
        lambda acc, i: F.struct(
            (acc["sum"] + F.least(F.lit(WINDOW_WORDS), i - acc["last"])).alias("sum"), i.alias("last")
        ),
        lambda acc: acc["sum"],
    )
    return six.select(
        *kept,
        "doc_id",
        "host",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("_n_lines").cast("long").alias("n_lines"),
    )


RULES = ("base", "symbols", "lines")


def host_verdicts(judged: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """``judged(host, <rule>_failed)`` to ``host, n_docs, <rule>_rate, rejected``.

    A rule's prior has the share of all documents that fail as its mean, and its
    strength follows from how much more the hosts' rates vary than chance alone
    makes them. Hosts that vary no more than that get a prior as strong as all
    rows, and none of them is rejected.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(F.col(f"{r}_failed").cast("long")).alias(f"_{r}") for r in rules))
    total = hosts.agg(
        F.sum("n_docs").alias("n"), F.count("*").alias("hosts"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("n2"), *(F.sum(f"_{r}").alias(r) for r in rules)
    ).first()  # a few numbers
    n = total["n"] or 0
    means = {r: (total[r] or 0) / max(n, 1) for r in rules}
    rate = lambda r: F.col(f"_{r}") / F.col("n_docs")
    spread = hosts.agg(*(F.sum(F.col("n_docs") * F.pow(rate(r) - F.lit(means[r]), F.lit(2.0))).alias(r) for r in rules)).first()
    rejected = F.lit(False)
    for r in rules:
        mean = means[r]
        chance = mean * (1 - mean)
        # E[spread] = (hosts - 1) * chance + extra * (n - n2 / n) * chance, extra = 1 / (1 + strength) roughly
        free = n - (total["n2"] or 0) / max(n, 1)
        extra = (spread[r] - (total["hosts"] - 1) * chance) / (free * chance) if chance > 0 and free > 0 else 0.0
        strength = max(1.0, min(float(max(n, 1)), 1 / extra - 1 if extra > 0 else float(max(n, 1))))
        limit = min(HIGHEST, max(TIMES_MEAN * mean, mean + SPREADS * (chance / (strength + 1)) ** 0.5))
        weight = F.col("n_docs") + F.lit(strength)
        shrunk = (F.col(f"_{r}") + F.lit(strength * mean)) / weight
        low = shrunk - F.lit(BENEFIT) * F.sqrt(shrunk * (1 - shrunk) / (weight + 1))
        hosts = hosts.withColumn(f"{r}_rate", shrunk)
        rejected = rejected | (low > F.lit(limit))
    return hosts.withColumn("rejected", rejected).select("host", "n_docs", *(f"{r}_rate" for r in rules), "rejected")


def quality_verdicts(docs: DataFrame, host: str = "source", whole_rows: bool = False) -> DataFrame:
    """Counts, rules and verdicts, one row per document.

    A null host is a host of its own. Documents without a word fail the first
    rule. Ties at a limit are kept. Repeated rows are judged each and counted each.
    """
    counts = stored(document_rules(docs, host, whole_rows), "quality")
    rules = counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbols_failed": F.col("n_symbols") > SYMBOLS_A_WORD * F.col("n_words"),
            "lines_failed": F.col("n_dup_lines") > DUP_LINE_SHARE * F.col("n_lines"),
        }
    )
    hosts = small(stored(host_verdicts(rules), "hosts"), FEW_HOSTS)
    return (
        rules.alias("r")
        .join(hosts.alias("h"), F.col("r.host").eqNullSafe(F.col("h.host")), "left")
        .select("r.*", "h.n_docs", *(f"h.{r}_rate" for r in RULES), "h.rejected")
        .withColumn("kept", ~(F.col("base_failed") | F.col("rejected")))
    )


def op6_host_quality(docs: DataFrame) -> DataFrame:
    """The contract's columns, the host's expected rates of failures and whether it is rejected.

    Null texts have no words and fail; a null source is a host of its own; rows
    that repeat are judged each; other columns are ignored. An empty table
    gives no rows.
    """
    return quality_verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(F.round(f"{r}_rate", 6).alias(f"{r}_rate") for r in RULES), "rejected"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, columns as they came.

    Each row is judged by itself, also where rows share a doc_id: rows are
    written once with their verdicts and read again, so no text is shuffled.
    """
    return unpacked(quality_verdicts(docs, whole_rows=True).where("kept"), docs.columns)
