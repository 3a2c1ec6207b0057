"""URL filter: rules by host and path, and a tree of path templates for the rest.

URLs that a rule fits are the labelled ones. For each host the paths form a
tree of segments. Going down, a segment becomes a wildcard if it looks like an
identifier, or if its parent has many children with few pages each; siblings
whose labels do not differ from those of all siblings are merged into one
branch. A template's share of blocked labels is smoothed towards that of the
same template on all hosts, that towards the host's, and that towards the
whole table's; templates with over half blocked are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatebed.llm.common import forget, small, stored

#: verdict, host, path: a rule fits its host and subdomains and paths that start with its own.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A node with more children than this, and fewer pages a child, has variable children.
MANY_CHILDREN, FEW_PAGES = 20, 5.0
#: Standard errors from the siblings' common rate up to which a branch is merged.
SIMILAR = 1.96
#: Labels that a branch needs to be called similar to its siblings.
FEWEST_LABELS = 5
#: Labels that each smoothing prior counts for.
PRIOR = 4.0
REJECT = 0.5
#: Nodes up to which they are broadcast; beyond, rows of one node are spread over so many tasks.
FEW_NODES, SALTS = 200_000, 16
#: Segments that name one thing: numbers with or without an ending, long hex or mixed codes.
_IDENTIFIER = r"^(\d+(\.[A-Za-z]{1,5})?|[0-9a-fA-F-]{12,}|(?=.*\d)[A-Za-z0-9_=-]{16,})$"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _looked_up(rows: DataFrame, nodes: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Rows with what ``nodes`` has for their keys.

    Few nodes are broadcast. Many are joined by a shuffle, in which the rows of
    one key go to SALTS tasks by a hash of ``spread`` and its node to each of them.
    """
    nodes = stored(nodes, "nodes")
    if nodes.limit(FEW_NODES + 1).count() <= FEW_NODES:
        return rows.join(F.broadcast(nodes), keys, how)
    salted = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*keys, "_salt"], how).drop("_salt")


def path_templates(urls: DataFrame) -> DataFrame:
    """``urls(host, path, n, labelled, blocked)`` with the column ``template`` added.

    The tree is grown from fork to fork: each round settles the children of all
    nodes that have been reached, by two aggregations over host and node, and
    goes on to where the paths below them part. What paths have in common from
    there on, all of it for a path of its own, is taken over in the same round,
    so rounds are as many as forks on one path and not as many as segments.
    Paths that have ended are laid aside and not read again.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    named = F.transform(parts, lambda s: F.when(s.rlike(_IDENTIFIER), F.lit("*")).otherwise(s))
    rows = stored(urls.withColumn("rest", named).withColumn("template", F.lit("/")), "urls")
    done = [*urls.columns, "template"]
    ended = []
    while True:
        ended.append(rows.where(F.size("rest") == 0).select(done))
        open_rows = rows.where(F.size("rest") > 0)
        here = open_rows.select(*done, F.get("rest", F.lit(0)).alias("child"), F.slice("rest", F.lit(2), F.size("rest")).alias("below"))
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, ended)
        children = stored(
            here.groupBy("host", "template", "child").agg(
                F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.min("below").alias("low"), F.max("below").alias("high")
            ),
            "children",
        )
        nodes = children.groupBy("host", "template").agg(
            F.count("*").alias("kinds"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked")
        )
        rate = (F.col("all_blocked") + 1) / (F.col("all_labelled") + 2)
        apart = F.abs(F.col("blocked") - F.col("labelled") * rate) / F.sqrt(rate * (1 - rate) * F.greatest(F.col("labelled"), F.lit(1)))
        variable = (F.col("kinds") > MANY_CHILDREN) & (F.col("all_n") / F.col("kinds") < FEW_PAGES)
        alike = (F.col("kinds") > 1) & (F.col("labelled") >= FEWEST_LABELS) & (apart <= SIMILAR)
        named_children = _looked_up(children, nodes, ["host", "template"], "child").select(
            "host", "template", "child", F.when(variable, F.lit("*")).when(alike, F.lit("~")).otherwise(F.col("child")).alias("as"), "low", "high"
        )
        # what all paths below a branch begin with is what its first and its last path in order do
        branches = named_children.groupBy("host", "template", "as").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        common = branches.select("host", "template", "as", _common("low", "high").alias("common"))
        names = _looked_up(named_children.drop("low", "high"), common, ["host", "template", "as"], "child")
        names = names.where((F.col("as") != F.col("child")) | (F.col("common") > 0))
        found = _looked_up(here, names, ["host", "template", "child"], "path", "left")
        taken = F.concat(F.array(F.coalesce("as", "child")), F.slice("below", F.lit(1), F.coalesce("common", F.lit(0))))
        longer = found.select(
            *urls.columns, F.slice("below", F.coalesce("common", F.lit(0)) + 1, F.size("below")).alias("rest"), F.concat("template", F.array_join(taken, "/"), F.lit("/")).alias("template")
        )
        rows = stored(longer, "urls")
        forget(urls.sparkSession, children)


def _common(low: str, high: str) -> Column:
    """How many segments two paths begin with alike."""
    size = F.least(F.size(low), F.size(high))
    same = F.zip_with(F.slice(low, F.lit(1), size), F.slice(high, F.lit(1), size), lambda a, b: a == b)
    first = F.array_position(same, False).cast("int")
    return F.when(first == 0, size).otherwise(first - 1)


def template_purity(rows: DataFrame) -> DataFrame:
    """``host, template, purity``: the smoothed share of blocked labels."""
    leaves = stored(rows.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "leaves")
    total = leaves.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).first()
    base = ((total["b"] or 0) + 1.0) / ((total["l"] or 0) + 2.0)
    smooth = lambda b, n, prior: (b + PRIOR * prior) / (n + PRIOR)
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("host_l"), F.sum("blocked").alias("host_b"))
    shapes = leaves.groupBy("template").agg(F.sum("labelled").alias("shape_l"), F.sum("blocked").alias("shape_b"))
    host_rate = smooth(F.col("host_b"), F.col("host_l"), F.lit(base))
    shape_rate = smooth(F.col("shape_b"), F.col("shape_l"), host_rate)
    with_host = _looked_up(leaves, hosts, ["host"], "template")
    return _looked_up(with_host, shapes, ["template"], "host").select(
        "host", "template", smooth(F.col("blocked"), F.col("labelled"), shape_rate).alias("purity")
    )


def url_verdicts(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row.

    A null url, or one without ``://``, has an empty host and path and is judged
    by the template ``/`` of that host. Ties at one half are allowed. Pages of
    one host and path are one row of the tree, so a host with a third of all
    pages costs no more than its distinct paths.
    """
    split = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = split.withColumn("_rule", match_rule(F.col("host"), F.col("path")))
    urls = ruled.groupBy("host", "path").agg(
        F.count("*").alias("n"),
        F.sum(F.col("_rule").isNotNull().cast("long")).alias("labelled"),
        F.sum((F.coalesce(F.col("_rule.verdict"), F.lit("")) == "block").cast("long")).alias("blocked"),
    )
    rows = path_templates(urls)
    judged = _looked_up(rows.select("host", "path", "template"), template_purity(rows), ["host", "template"], "path")
    learned = F.when(F.col("purity") > REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(judged, ["host", "path"]).select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), learned).alias("verdict"),
        "template",
        "purity",
    )


def op10_url_templates(pages: DataFrame) -> DataFrame:
    """The contract's columns, the template and its smoothed share of blocked labels; see :func:`url_verdicts`.

    Rows that repeat are rows of their own; other columns are ignored; an empty
    table gives no rows. Paths may have any number of segments, and as many as one has cost no round each.
    """
    return url_verdicts(pages)
