"""Document quality by a sparse ensemble of rules.

Statistics of each text are Spark columns. Small trees are boosted on those of
a bounded sample of labelled documents; every path from a root to a node is a
rule, a conjunction of limits on statistics. A logistic model with a lasso
penalty over all rules and the clipped statistics keeps few of them; the
penalty is the strongest whose loss on held-back sample rows is within a
standard error of the least. What is left is compiled into one Spark column, so
that scoring needs no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatebed.llm.common import text_or_empty, words
from slatebed.llm.toxicity import fold

#: Labelled documents to learn from, at most, of each label: those with the
#: least hashes of doc_id. Only their statistics come to the driver.
MOST_OF_LABEL = 6000
#: Trees, their depth, documents of a leaf, limits tried for a statistic and the step of boosting.
TREES, DEPTH, LEAST_IN_LEAF, LIMITS, RATE = 40, 3, 5, 48, 0.15
#: Penalties tried, from the largest that is of use down to this part of it, and steps of each fit.
PENALTIES, LEAST_PENALTY, STEPS = 12, 3e-3, 100
#: One sample row in so many is held back to choose the penalty.
HELD_BACK = 4


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text, most of them shares; all zero for an empty one.

    ``_words`` and ``_lines`` are expected as columns beside it.
    """
    w, lines = F.col("_words"), F.col("_lines")
    n, size = F.size(w), F.length(text)
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    per_word = lambda pattern: share(count(pattern), n)
    return {
        "log_words": F.log1p(n.cast("double")),
        "chars_a_word": share(size, n),
        "distinct_words": share(F.size(F.array_distinct(w)), n),
        "distinct_to_root": share(F.size(F.array_distinct(w)), F.sqrt(n.cast("double"))),
        "repeats_before": share(F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))), n),
        "long_words": share(F.size(F.filter(w, lambda x: F.length(x) > 20)), n),
        "short_words": share(F.size(F.filter(w, lambda x: F.length(x) < 3)), n),
        "lines_a_word": share(F.size(lines), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "upper": share(count(r"\p{Lu}"), size),
        "letters": share(count(r"\p{L}"), size),
        "digits": share(count(r"[0-9]"), size),
        "stops_a_word": per_word(r"[.?!]"),
        "commas_a_word": per_word(r"[,;:]"),
        "bangs_a_word": per_word(r"!"),
        "bars_a_word": per_word(r"\|"),
        "symbols_a_word": per_word(r"[#*$%&<>{}=_\\^~]"),
        "links_a_word": per_word(r"://|www\."),
        "marked_words": share(F.size(F.filter(w, lambda x: x.rlike(r"[^\p{L}\p{N}]{2}"))), n),
    }


def with_statistics(docs: DataFrame, carried: list[Column], text: Column) -> tuple[DataFrame, list[str]]:
    """The carried columns and the statistics of every whole text, null as empty; and their names."""
    one = docs.select(*carried, F.coalesce(text, F.lit("")).alias("_text"))
    two = one.withColumns({"_words": words(F.col("_text")), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))})
    found = statistics(F.col("_text"))
    kept = [c for c in one.columns if c != "_text"]
    return two.select(*kept, *(c.cast("double").alias(name) for name, c in found.items())), list(found)


@dataclass(frozen=True)
class Limit:
    """``name <= at``, or ``name > at`` if ``over``."""

    name: str
    at: float
    over: bool


@dataclass
class RuleEnsemble:
    """Log odds of a document: ``bias``, weighted rules that hold, and weighted statistics clipped to their range."""

    bias: float
    rules: list[tuple[tuple[Limit, ...], float]] = field(default_factory=list)
    lines: list[tuple[str, float, float, float]] = field(default_factory=list)  # name, low, high, weight

    def column(self) -> Column:
        """The score as a column over the statistics' columns."""
        odds = F.lit(float(self.bias))
        for limits, weight in self.rules:
            holds = F.lit(True)
            for x in limits:
                holds = holds & ((F.col(x.name) > x.at) if x.over else (F.col(x.name) <= x.at))
            odds = odds + F.when(holds, float(weight)).otherwise(0.0)
        for name, low, high, weight in self.lines:
            odds = odds + F.lit(float(weight)) * F.greatest(F.lit(low), F.least(F.lit(high), F.col(name)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _grow(x: np.ndarray, bins: np.ndarray, limits: list[np.ndarray], gradient: np.ndarray, curvature: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """A regression tree: the paths to all of its nodes and the value of each row's leaf."""
    value, paths = np.zeros(len(x)), []
    todo = [((), np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        if path:
            paths.append(path)
        best = None
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_IN_LEAF:
            g, h = gradient[rows].sum(), curvature[rows].sum()
            for j, cuts in enumerate(limits):
                if not len(cuts):
                    continue
                of = bins[rows, j]
                n = np.cumsum(np.bincount(of, minlength=len(cuts) + 1))[:-1]
                left_g = np.cumsum(np.bincount(of, gradient[rows], len(cuts) + 1))[:-1]
                left_h = np.cumsum(np.bincount(of, curvature[rows], len(cuts) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                gain[(n < LEAST_IN_LEAF) | (len(rows) - n < LEAST_IN_LEAF)] = -1
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k)
        if best is None:
            value[rows] = gradient[rows].sum() / (curvature[rows].sum() + 1)
            continue
        _, j, k = best
        under = bins[rows, j] <= k
        todo += [(path + ((j, k, True),), rows[~under]), (path + ((j, k, False),), rows[under])]
    return paths, value


def _boosted_rules(x: np.ndarray, y: np.ndarray, limits: list[np.ndarray]) -> list[tuple]:
    """Different paths of boosted trees; paths that differ only in order are one."""
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(limits)], axis=1)
    odds, rules = np.full(len(x), np.log(y.mean() / (1 - y.mean()))), {}
    draw = np.random.default_rng(1)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        rows = draw.random(len(x)) < 0.6
        if not rows.any():
            continue
        paths, _ = _grow(x[rows], bins[rows], limits, (y - p)[rows], (p * (1 - p))[rows])
        for path in paths:
            rules.setdefault(tuple(sorted(set(path))), None)
        odds += RATE * _leaf_values(bins, paths, y - p, p * (1 - p))
    return list(rules)


def _holds(bins: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(bins), bool)
    for j, k, over in path:
        out &= (bins[:, j] > k) == over
    return out


def _leaf_values(bins: np.ndarray, paths: list[tuple], gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """The step of every row by the deepest paths, which no other one continues."""
    inner = {path[:-1] for path in paths}
    value = np.zeros(len(bins))
    for path in paths:
        if path not in inner:
            rows = _holds(bins, path)
            value[rows] = gradient[rows].sum() / (curvature[rows].sum() + 1)
    return value


def _lasso(x: np.ndarray, y: np.ndarray, penalties: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Logistic weights and bias for each penalty, each fit from the one before, by accelerated proximal steps."""
    y = y.astype(x.dtype)
    w, b, out = np.zeros(x.shape[1], x.dtype), x.dtype.type(np.log(y.mean() / (1 - y.mean()))), []
    # the largest curvature, by power iteration
    v = np.ones(x.shape[1] + 1, x.dtype)
    for _ in range(20):
        t = x @ v[:-1] + v[-1]
        v = np.append(x.T @ t, t.sum())
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    rate = 4 * len(x) / norm
    for penalty in penalties.tolist():
        u, c, before = w, b, 1.0
        for _ in range(STEPS):
            gap = 1 / (1 + np.exp(-np.clip(x @ u + c, -30, 30))) - y
            moved = u - rate * (x.T @ gap) / len(x)
            new_w = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
            new_b = c - rate * gap.mean()
            after = (1 + math.sqrt(1 + 4 * before**2)) / 2
            u, c = new_w + (before - 1) / after * (new_w - w), new_b + (before - 1) / after * (new_b - b)
            still = np.abs(new_w - w).max(initial=0) < 1e-5 and abs(new_b - b) < 1e-5
            w, b, before = new_w, new_b, after
            if still:
                break
        out.append((w.copy(), b))
    return out


def fit(names: list[str], x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Fits the ensemble to rows of statistics and labels, in the order given.

    With one label only, or none, the score is a constant.
    """
    y = np.asarray(y, float)
    if len(y) < 2 * LEAST_IN_LEAF or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return RuleEnsemble(float(np.log(share / (1 - share))))
    limits = []
    for j in range(x.shape[1]):
        at = np.unique(x[:, j])
        middle = (at[1:] + at[:-1]) / 2
        wanted = np.unique(np.quantile(x[:, j], np.linspace(0, 1, LIMITS + 2)[1:-1]))
        limits.append(np.unique(middle[np.clip(np.searchsorted(middle, wanted), 0, len(middle) - 1)]) if len(middle) else middle)
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(limits)], axis=1)
    rules = _boosted_rules(x, y, limits)
    # of rules that hold for the same rows the shortest
    different = {}
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        holds = _holds(bins, rule)
        if holds.any() and not holds.all():
            different.setdefault(np.packbits(holds).tobytes(), rule)
    rules = list(different.values())
    low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    clipped = np.clip(x, low, high)
    scale = np.where(clipped.std(axis=0) > 1e-12, clipped.std(axis=0), np.inf)
    # a line counts as much as a rule of the usual support
    terms = np.empty((len(x), len(rules) + x.shape[1]), np.float32)
    for i, rule in enumerate(rules):
        terms[:, i] = _holds(bins, rule)
    terms[:, len(rules) :] = 0.4 * (clipped - clipped.mean(axis=0)) / scale
    held = np.zeros(len(y), bool)
    for label in (0, 1):  # some of each label, those of the sample's order
        held[np.flatnonzero(y == label)[::HELD_BACK]] = True
    most = np.abs(terms[~held].T @ (y[~held] - y[~held].mean())).max() / (~held).sum()
    penalties = most * np.geomspace(1, LEAST_PENALTY, PENALTIES)
    losses, spreads = [], []
    for w, b in _lasso(terms[~held], y[~held], penalties):
        z = np.clip(terms[held] @ w + b, -30, 30)
        loss = np.logaddexp(0, z) - y[held] * z
        losses.append(loss.mean())
        spreads.append(loss.std() / np.sqrt(held.sum()))
    least = int(np.argmin(losses))
    chosen = next(i for i, loss in enumerate(losses) if loss <= losses[least] + spreads[least])
    w, b = _lasso(terms, y, penalties[: chosen + 1])[-1]
    model = RuleEnsemble(float(b))
    for path, weight in zip(rules, w[: len(rules)]):
        if weight:
            model.rules.append((tuple(Limit(names[j], float(limits[j][k]), over) for j, k, over in path), float(weight)))
    for j, weight in enumerate(w[len(rules) :]):
        if weight:
            each = float(0.4 * weight / scale[j])
            model.lines.append((names[j], float(low[j]), float(high[j]), each))
            model.bias -= each * float(clipped[:, j].mean())
    return model


def learn(docs: DataFrame, labels: DataFrame, outside: Column | None = None) -> RuleEnsemble:
    """Fits on the labelled documents for whose label ``outside`` (over doc_id) is not true.

    Of several labels of a doc_id the worst counts; a null label or doc_id is none.
    Different texts of one doc_id are documents of their own, equal ones are
    one. At most MOST_OF_LABEL documents of each label are learned from.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if outside is not None:
        marked = marked.where(~outside)
    # labels without a document must not use up the sample
    here = marked.join(docs.select("doc_id"), "doc_id", "left_semi")
    xs, ys, names = [], [], []
    for label in (0, 1):
        some = here.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_OF_LABEL).select("doc_id")
        theirs = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id")  # so many rows at most
        rows, names = with_statistics(theirs, [F.col("doc_id"), F.xxhash64("text").alias("_th")], F.col("text"))
        rows = rows.dropDuplicates(["doc_id", "_th"]).orderBy(F.xxhash64("doc_id"), "doc_id", "_th").limit(MOST_OF_LABEL)
        found = rows.select(*names).toArrow()
        xs.append(np.stack([found[c].to_numpy() for c in names], axis=1).astype(float).reshape(-1, len(names)))
        ys.append(np.full(len(found), label))
    return fit(names, np.concatenate(xs), np.concatenate(ys))


def scored(docs: DataFrame, model: RuleEnsemble, carried: list[Column], text: Column) -> DataFrame:
    """The carried columns and ``score`` of each row."""
    rows, names = with_statistics(docs, carried, text)
    return rows.withColumn("score", model.column()).drop(*names)


def op12_rule_ensemble(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns.

    Null texts are empty ones and have the score of an empty text; rows that
    repeat are each scored; a null doc_id has the fold of an empty text and is
    never learned from; other columns are ignored; without labels every score
    is 0.5; an empty table gives no rows.
    """
    held_out = fold(F.col("doc_id"), 3) == 1
    model = learn(docs, labels, held_out)
    return scored(docs, model, [F.col("doc_id")], F.col("text")).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
