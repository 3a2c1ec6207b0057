"""Near copies by five-word shingles: no link lost among short texts, recall in crowds."""

from __future__ import annotations

import random

import numpy as np
import pytest

from slatebed.llm import simhash
from slatebed.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(out) + 1)
        if kind == 0:
            out.insert(at, f"n{rng.randrange(10**6)}")
        elif kind == 1 and out:
            del out[min(at, len(out) - 1)]
        elif out:
            out[min(at, len(out) - 1)] = f"s{rng.randrange(10**6)}"
    return out


def brute_kept(rows):
    """One row of each connected group, the smallest doc_id."""
    sets = [shingles(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and sets[i] and sets[j]:
                parent[root(i)] = root(j)
    best: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), 10**9), doc_id)
    return sorted(best.values())


def test_short_texts_lose_no_link(spark):
    rng = random.Random(21)
    rows = []
    for k in range(160):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 86))]
        rows.append(base)
        for _ in range(rng.randrange(1, 4)):
            rows.append(edited(rng, base, rng.choice([1, 1, 1, 2])))
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(9000, ""), (9001, None), (9002, " \n"), (9003, "one"), (9004, "ONE")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    kept = sorted(r.doc_id for r in simhash.keep_one_per_component(df).collect())
    assert kept == brute_kept(rows)


def test_least_hashes_meet_at_the_similarity():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(1, 81))
        union = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        n = len(union)
        missing = rng.permutation(n)[: n // 5]  # at least four fifths in both
        cut = int(rng.integers(0, len(missing) + 1))
        a, b = np.delete(union, missing[:cut]), np.delete(union, missing[cut:])
        if 5 * len(np.intersect1d(a, b)) >= 4 * n:
            assert len(np.intersect1d(simhash._least_hashes(a), simhash._least_hashes(b)))


def test_recall_of_links_in_a_crowd(spark):
    """A text with 300 near copies, 150 others around one passage, and near copies of some of these."""
    rng = random.Random(22)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, passage = [word() for _ in range(160)], [word() for _ in range(60)]
    texts = [base] + [edited(rng, base, rng.randrange(1, 4)) for _ in range(300)]
    around = [[word() for _ in range(60)] + passage + [word() for _ in range(40)] for _ in range(150)]
    texts += around + [edited(rng, t, 2) for t in around[:60]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    sets = [shingles(t) for _, t in rows]
    true = {(i, j) for j in range(len(rows)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8}
    kept = sorted(r.doc_id for r in simhash.keep_one_per_component(df).collect())
    assert kept == brute_kept(rows)
    # of the links, those that connect are found in any case; pairs outside of crowds all are
    told = df.selectExpr("doc_id as uid", "text").mapInArrow(simhash._near_batches, "uid long, fp long, digest binary, n long, keys array<long>")
    candidates = {(r.a, r.b) for r in simhash.near_candidates(stored(told.drop("digest"), "told")).collect()}
    outside = {(i, j) for i, j in true if i > 300}
    assert len(outside) >= 40 and outside <= candidates
    assert len(candidates) < 40 * len(rows)  # far from all pairs


@pytest.mark.parametrize("rounds", [1, 2])
def test_links_whose_only_key_is_crowded_are_found(spark, monkeypatch, rounds):
    """Texts put together from the same passages and near copies of some, under one key; the centre is like few of them."""
    rng = random.Random(23)
    slots = [[[f"w{rng.randrange(10**6)}" for _ in range(27)] for _ in range(2)] for _ in range(6)]
    mixed = [[w for k, slot in enumerate(slots) for w in slot[i >> k & 1]] for i in range(64)]
    texts = mixed + [edited(rng, mixed[i], rng.randrange(1, 4)) for i in rng.sample(range(64), 30)]
    words = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingles(t) for _, t in words]
    monkeypatch.setattr(simhash, "CROWDED", 3)
    monkeypatch.setattr(simhash, "ROUNDS", rounds, raising=False)
    rows = spark.createDataFrame([(i, (t,)) for i, t in words], "uid long, row struct<text string>")
    # fingerprints that are far from each other, one key for all
    far = spark.createDataFrame([(i, i * 0x0101010101010101 % 2**62, len(sets[i]), [1]) for i, _ in words], "uid long, fp long, n long, keys array<long>")
    found = [(r.a, r.b) for r in simhash.near_links(rows, stored(far, "far")).collect()]
    assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in found)
    parent = list(range(len(words)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert sorted({root(i) for i in parent}) == brute_kept(words)


def test_pairs_made_in_a_crowd_grow_with_its_rows(spark, monkeypatch):
    """Near copies of one text, some too far from it and from each other to be linked."""
    rng = random.Random(24)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [edited(rng, base, rng.choice([1, 2, 5, 6, 7])) for _ in range(240)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    made = []

    def counted(df, name, put=simhash.stored):
        found = put(df, name)
        if name in ("pairs", "crowd_pairs"):
            made.append(found.count())
        return found

    monkeypatch.setattr(simhash, "stored", counted)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = sorted(r.doc_id for r in simhash.keep_one_per_component(df).collect())
    assert kept == brute_kept(rows) and len(kept) > 1
    assert 0 < sum(made) < 10 * len(rows)
