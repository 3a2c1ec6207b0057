"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled first: features of words
(the word, its beginnings and endings) that are much commoner in toxic
documents mark the tokens of toxic documents as toxic, all other tokens are
not. A two-state chain is fitted to these labels by gradient steps on its
likelihood. Its forward-backward marginals say how likely each token is to be
toxic; a logistic model turns a document's marginals into its score.

The chain is run as odds: with two states the forward and the backward message
are one number each. Texts are cut into pieces of WIDTH tokens that are steps
for all pieces of a batch at once; what a piece does to a message is a matrix
of two by two, by which the messages at its ends are carried over from piece to
piece, so a text of any length has the marginals of one chain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatebed.llm.common import scratch, stored, text_or_empty

#: Labelled documents to learn from, at most, of each label, and bytes of their
#: texts. They are those with the least hashes of doc_id, so a sample is the
#: same on every run. All of their tokens are learned from.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 2000, 3500, 1 << 26
#: A feature marks tokens if its log odds are so large, and so many standard
#: errors (the root of the likelihood ratio) from none.
LOG_ODDS, ERRORS, FEWEST_DOCS = 1.2, 4.5, 4
STEPS, PRIOR = 100, 1e-4
#: Tokens of a piece, cells of a matrix of pieces by tokens, and words a worker remembers.
WIDTH, CELLS, REMEMBERED = 256, 1 << 20, 400_000
#: Tokens of a piece in learning, which has the last token of the one before as its first.
LEARNED_WIDTH, LEARNED_ROWS = 32, 1 << 14
#: Odds of a token whose state is known.
GIVEN = 1e9
_TOKEN = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    word = word.lower()
    found = ["w" + word]
    for n in (3, 4, 5, 6, 7):
        if len(word) > n:
            found.append("<" + word[:n])
            found.append(">" + word[-n:])
    return found


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    moves: np.ndarray  # 2 x 2, log
    document: np.ndarray  # weights of document_features

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in word_features(word))


def chain(
    odds: np.ndarray, moves: np.ndarray, inside: np.ndarray | None = None, before: np.ndarray | None = None, after: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of state 1 for ``odds[piece, token]`` of emissions.

    Marginal odds are the product of the two. Tokens outside of ``inside``, at
    the end of a row, have odds one and send nothing back. ``before`` has the
    forward odds of the token before each piece, not a number where there is
    none; ``after`` the backward odds at its last token, one where nothing follows.
    """
    stay0, up, down, stay1 = np.exp(moves).ravel()
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    r = odds[:, 0].copy()
    if before is not None:
        r = np.where(np.isnan(before), r, r * (up + before * stay1) / (stay0 + before * down))
    forward[:, 0] = r
    for t in range(1, odds.shape[1]):
        r = odds[:, t] * (up + r * stay1) / (stay0 + r * down)
        forward[:, t] = r
    b = np.ones(len(odds)) if after is None else after
    backward[:, -1] = b
    start = b
    for t in range(odds.shape[1] - 2, -1, -1):
        x = odds[:, t + 1] * b
        b = (down + stay1 * x) / (stay0 + up * x)
        if inside is not None:
            b = np.where(inside[:, t + 1], b, start)
        backward[:, t] = b
    return forward, backward


def document_features(marginals: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: 1, expected toxic tokens (log and share), largest marginal, length."""
    total, top = np.zeros(len(sizes)), np.zeros(len(sizes))
    some = sizes > 0
    if some.any():
        total[some] = np.add.reduceat(marginals, starts[some])
        top[some] = np.maximum.reduceat(marginals, starts[some])
    n = np.maximum(sizes, 1)
    return np.stack([np.ones(len(sizes)), np.log1p(total), np.sqrt(total / n) * 5, top, np.log1p(sizes) / 5, total > 1.5], axis=1)


def marginals(emissions: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of state 1 of each token, for documents laid end to end."""
    out = np.empty(len(emissions))
    odds = np.exp(np.clip(emissions, -30, 30))
    pieces = -(-sizes // WIDTH)
    of = np.repeat(np.arange(len(sizes)), pieces)
    place = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(sizes) - sizes)[of] + place * WIDTH
    lengths = np.minimum(sizes[of] - place * WIDTH, WIDTH)
    before, after = np.full(len(of), np.nan), np.ones(len(of))
    long = np.flatnonzero(pieces[of] > 1)
    if len(long):
        through = np.empty((len(of), 2, 2))
        for rows, cells, inside in _matrices(long, starts, lengths):
            through[rows] = _transfers(np.where(inside, odds[cells], 1.0), inside, place[rows] == 0, moves)
        _carry(through, long, of, place, pieces, before, after)
    for rows, cells, inside in _matrices(np.arange(len(of)), starts, lengths):
        f, b = chain(np.where(inside, odds[cells], 1.0), moves, inside, before[rows], after[rows])
        both = f * b
        out[cells[inside]] = (both / (1 + both))[inside]
    return out


def _matrices(pieces: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of similar length, the places of their tokens and which places are theirs."""
    order = pieces[np.argsort(lengths[pieces], kind="stable")]
    at = 0
    while at < len(order):
        limit = max(16, int(1.3 * lengths[order[at]]))
        end = min(int(np.searchsorted(lengths[order], limit, side="right")), at + max(1, CELLS // limit))
        rows = order[at:end]
        steps = np.arange(int(lengths[rows[-1]]))
        inside = steps < lengths[rows][:, None]
        yield rows, np.where(inside, starts[rows][:, None] + steps, starts[rows][:, None]), inside
        at = end


def _transfers(odds: np.ndarray, inside: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """What each piece does to the two weights of a message, up to a factor.

    The first piece of a text takes no message; its first column is the message
    that it sends on.
    """
    stay0, up, down, stay1 = np.exp(moves).ravel()
    state = np.tile(np.eye(2), (len(odds), 1, 1))
    state[first, :, 0] = np.stack((np.ones(first.sum()), odds[first, 0]), axis=1)
    for t in range(odds.shape[1]):
        zero = stay0 * state[:, 0] + down * state[:, 1]
        one = odds[:, t, None] * (up * state[:, 0] + stay1 * state[:, 1])
        total = (zero + one).sum(axis=1, keepdims=True)
        goes = inside[:, t] & ~(first & (t == 0))
        state[goes, 0], state[goes, 1] = (zero / total)[goes], (one / total)[goes]
    return state


def _carry(through: np.ndarray, long: np.ndarray, of: np.ndarray, place: np.ndarray, pieces: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """Fills in the message odds at the ends of the pieces of long texts."""
    for first in long[place[long] == 0].tolist():
        last = first + int(pieces[of[first]]) - 1
        v = through[first, :, 0]
        for i in range(first + 1, last + 1):
            before[i] = v[1] / v[0]
            v = through[i] @ v
            v = v / v.sum()
        w = np.ones(2)
        for i in range(last, first, -1):
            w = through[i].T @ w
            w = w / w.sum()
            after[i - 1] = w[1] / w[0]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _deviance(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Twice the log likelihood ratio of two shares against one common share."""
    share = counts.sum(axis=0) / totals.sum()
    out = np.zeros(counts.shape[1])
    for n, total in zip(counts, totals):
        for seen, expected in ((n, total * share), (total - n, total * (1 - share))):
            out += 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))
    return out


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Fits the model to labelled documents; with one label only, scores are its constant."""
    toxic_of = np.array(toxic, bool)
    if not len(texts) or toxic_of.all() or not toxic_of.any():
        share = float(np.clip(toxic_of.mean() if len(texts) else 0.0, 0.01, 0.99))
        return Model({}, 0.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    words: dict[str, int] = {}
    docs = [np.array([words.setdefault(w, len(words)) for w in _TOKEN.findall(t)], np.int32) for t in texts]
    spelled = list(words)
    first: Counter = Counter()
    for tokens, label in zip(docs, toxic):
        if label:
            first.update(set().union(*(word_features(spelled[w]) for w in np.unique(tokens))))
    names = [f for f, n in first.items() if n >= FEWEST_DOCS]
    number = {f: i for i, f in enumerate(names)}
    del first
    features_of = [np.array([number[f] for f in word_features(w) if f in number], np.int32) for w in spelled]
    counts = np.zeros((2, len(names)))
    for tokens, label in zip(docs, toxic):
        if len(tokens):
            counts[label, np.unique(np.concatenate([features_of[w] for w in np.unique(tokens)]))] += 1
    n0, n1 = (~toxic_of).sum(), toxic_of.sum()
    odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))
    marks = (odds > LOG_ODDS) & (_deviance(counts, np.array([n0, n1], float)) > ERRORS**2)
    marked_word = np.array([marks[f].any() for f in features_of])
    # features of the chain: those that mark and all of words that are marked
    near = np.zeros(len(names))
    for w in np.flatnonzero(marked_word):
        near[features_of[w]] += 1
    ranked = np.lexsort((np.arange(len(names)), -near, ~marks))
    ranked = ranked[(marks | (near > 0))[ranked]]
    kept = [names[i] for i in ranked]
    index = np.full(len(names), -1)
    index[ranked] = np.arange(len(ranked))
    of_word = np.repeat(np.arange(len(words)), [len(f) for f in features_of])
    feature = index[np.concatenate(features_of)] if len(words) else np.zeros(0, np.int64)
    of_word, feature = of_word[feature >= 0], feature[feature >= 0]
    del features_of
    # pieces of fixed length that overlap by a token, so that every move from token to token is in one of them
    steps = np.arange(LEARNED_WIDTH)
    parts: list[tuple[np.ndarray, ...]] = []
    for tokens, label in zip(docs, toxic):
        if len(tokens):
            at = np.arange(0, max(1, len(tokens) - 1), LEARNED_WIDTH - 1)[:, None] + steps
            real = at < len(tokens)
            piece = tokens[np.minimum(at, len(tokens) - 1)]
            parts.append((piece, real, real & ((steps > 0) | (at == 0)), marked_word[piece] & bool(label) & real))
    token, real, own, y = (np.concatenate([p[i] for p in parts]) for i in range(4))
    del parts
    # pieces without a word that any feature knows are alike to the chain if they are as long: one of each kind, weighted
    known = np.bincount(of_word, minlength=len(words)) > 0
    plain = ~(known[token] & real).any(axis=1)
    _, at, times = np.unique(2 * real[plain].sum(axis=1) + own[plain, 0], return_index=True, return_counts=True)
    rows = np.concatenate((np.flatnonzero(~plain), np.flatnonzero(plain)[at]))
    weight = np.concatenate((np.ones((~plain).sum()), times))[:, None]
    token, y, real, own = token[rows], y[rows], real[rows], own[rows]
    weights, bias, moves = np.zeros(len(kept)), -4.0, np.log(np.array([[0.95, 0.05], [0.6, 0.4]]))
    g2w, g2b, g2m = np.full(len(kept), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    n = (own * weight).sum()
    for _ in range(STEPS):
        of = np.bincount(of_word, weights[feature], len(words)) + bias
        by_word, grad_m, e = np.zeros(len(words)), np.zeros(4), np.exp(moves)
        for low in range(0, len(token), LEARNED_ROWS):
            part = slice(low, low + LEARNED_ROWS)
            here, label = real[part], y[part]
            odds = np.where(here, np.exp(np.clip(of[token[part]], -30, 30)), 1.0)
            # what the piece before has ended with is given
            odds[:, 0] = np.where(own[part, 0], odds[:, 0], np.where(label[:, 0], GIVEN, 1 / GIVEN))
            f, b = chain(odds, moves, here)
            both = f * b
            gap = np.where(own[part], label - both / (1 + both), 0.0) * weight[part]
            by_word += np.bincount(token[part].ravel(), gap.ravel(), len(words))
            x = odds[:, 1:] * b[:, 1:]
            joint = np.stack([np.ones_like(x) * e[0, 0], e[0, 1] * x, f[:, :-1] * e[1, 0], f[:, :-1] * e[1, 1] * x])
            joint /= joint.sum(axis=0)
            seen = np.stack([~label[:, :-1] & ~label[:, 1:], ~label[:, :-1] & label[:, 1:], label[:, :-1] & ~label[:, 1:], label[:, :-1] & label[:, 1:]])
            grad_m += ((seen - joint) * (here[:, 1:] * weight[part])).sum(axis=(1, 2))
        grad_w = np.bincount(feature, by_word[of_word], len(kept)) / n - PRIOR * weights
        grad_b = by_word.sum() / n
        grad_m = grad_m.reshape(2, 2) / n
        g2w, g2b, g2m = g2w + grad_w**2, g2b + grad_b**2, g2m + grad_m**2
        weights += 0.5 * grad_w / np.sqrt(g2w)
        bias += 0.3 * grad_b / np.sqrt(g2b)
        moves += 0.2 * grad_m / np.sqrt(g2m)
    model = Model({f: float(w) for f, w in zip(kept, weights) if abs(w) > 1e-3}, float(bias), moves, np.zeros(6))
    of = np.bincount(of_word, weights[feature], len(words)) + bias
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes) - sizes
    p = marginals(of[np.concatenate(docs)], sizes, moves)
    x = document_features(p, starts, sizes)
    model.document = _logistic(x, toxic_of.astype(float), np.ones(len(docs)))
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def __call__(self, texts: list[str]) -> Iterator[tuple[float, list[tuple[int, int]]]]:
        """Score and toxic spans (code points, end excluded) of each text, empty ones too."""
        at = 0
        while at < len(texts):
            tokens, size, end = [], 0, at
            while end < len(texts) and size < CELLS // 4:
                tokens.append(_TOKEN.findall(texts[end]))
                size += len(tokens[-1])
                end += 1
            if len(self.known) > REMEMBERED:
                self.known.clear()
            known, emission = self.known, self.model.emission
            for w in set().union(*tokens).difference(known):
                known[w] = emission(w)
            sizes = np.array([len(t) for t in tokens])
            starts = np.cumsum(sizes) - sizes
            flat = np.array([known[w] for t in tokens for w in t])
            p = marginals(flat, sizes, self.model.moves)
            x = document_features(p, starts, sizes) @ self.model.document
            scores = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            hot = np.add.reduceat(np.append(p > 0.5, False), starts) if len(starts) else []
            for i in range(len(tokens)):
                spans = _spans(texts[at + i], p[starts[i] : starts[i] + sizes[i]]) if sizes[i] and hot[i] else []
                yield float(scores[i]), spans
            at = end


def _spans(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    last = -2
    for i, (m, toxic) in enumerate(zip(_TOKEN.finditer(text), (p > 0.5).tolist())):
        if toxic:
            if last == i - 1:
                spans[-1] = (spans[-1][0], m.end())
            else:
                spans.append(m.span())
            last = i
    return spans


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo the folds; a null doc_id is an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Fits on labelled documents whose fold is not 0.

    Several labels of one doc_id count as toxic if any is; a null label is
    none. Different texts of one doc_id are documents of their own, equal ones
    are one. Of each label at most MOST_TOXIC or MOST_CLEAN come to the driver,
    and no more whole texts than MOST_BYTES hold, texts that don't fit being
    passed over: the bound of the sample, whatever the tables have. Without labelled documents the model is constant.
    """
    spark = docs.sparkSession
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id"), folds) != 0)
    kinds = ((1, MOST_TOXIC), (0, MOST_CLEAN))
    least = [marked.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for value, most in kinds]
    some = F.broadcast(least[0].union(least[1]))  # so many rows at most
    with scratch(spark):
        every = docs.select("doc_id", text_or_empty().alias("text")).join(some, "doc_id")
        theirs = stored(every.withColumns({"th": F.xxhash64("text"), "size": F.octet_length("text")}), "labelled")
        texts, label = [], []
        for value, most in kinds:
            mine = theirs.where(F.col("toxic") == value)
            first = mine.select("doc_id", "th", "size").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(most).collect()
            chosen, left = [], MOST_BYTES
            for row in first:  # a text that doesn't fit is passed over, those behind it aren't
                if row["size"] <= left:
                    left -= row["size"]
                    chosen.append((row["doc_id"], row["th"]))
            wanted = F.broadcast(spark.createDataFrame(chosen, "doc_id long, th long"))
            found = mine.join(wanted, ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.first("text").alias("text")).toArrow()["text"].to_pylist()
            texts += found
            label += [value] * len(found)
    order = sorted(range(len(texts)), key=lambda i: (label[i], texts[i]))  # the same model whatever the order of rows
    return fit([texts[i] for i in order], [label[i] for i in order])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, spans`` of each row; null texts are empty and have no spans."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    made: dict[int, Scorer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = made.setdefault(0, Scorer(shipped.value))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            done = list(scorer(batch.column(1).to_pylist()))
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"]
            )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, score double, spans array<struct<start:int,end:int>>"
    )


def op4_crf_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, the number of toxic spans and their offsets in code points.

    Null and empty texts have the score of a text without tokens; rows that
    repeat are each scored; a null doc_id has the fold of an empty text; other
    columns are ignored; an empty table gives no rows.
    """
    scored = toxicity(docs, learn(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("offsets"),
    )
