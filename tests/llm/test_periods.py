"""Periodic runs against a search by definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from slatebed.llm import periods
from slatebed.llm.periods import find_runs, op13_periodic_runs, periodic_runs

DOCS = "doc_id long, text string"


def brute_runs(ws):
    found = set()
    n = len(ws)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and ws[j] == ws[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p) and not any(all(ws[x] == ws[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                found.add((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    ws = [w for w in __import__("re").split(r"[ \x09-\x0D]+", text or "") if w]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(ws)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = brute_runs(ws)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
        sha(" ".join(w for i, w in enumerate(ws) if i not in gone)),
    )


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 4), st.integers(0, 160))
def test_runs_of_random_words(seed, letters, n):
    draw = random.Random(seed)
    ws = [draw.randrange(letters) for _ in range(n)]
    if n > 60:  # a planted repeat inside
        p, a = draw.randint(1, 15), draw.randint(0, 20)
        for i in range(a + p, min(n, a + draw.randint(3, 7) * p + 24)):
            ws[i] = ws[i - p]
    found = find_runs(np.array(ws, np.int64), np.array([0, n, 0]))
    assert set(found[0].tolist()) <= {1}
    assert list(zip(*(x.tolist() for x in found[1:]))) == brute_runs(ws)


def test_texts_dont_run_into_each_other_and_small_grids_agree(monkeypatch):
    draw = random.Random(7)
    texts = [[draw.randrange(2) for _ in range(draw.randint(0, 90))] for _ in range(40)] + [[1] * 200, [1] * 23, [1] * 24, [0, 1, 1] * 30]
    ids, sizes = np.concatenate([np.array(t, np.int64) for t in texts]), np.array([len(t) for t in texts])
    whole = find_runs(ids, sizes)
    expected = [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t)]
    assert list(zip(*(x.tolist() for x in whole))) == expected
    monkeypatch.setattr(periods, "PAIRS", 5)
    assert list(zip(*(x.tolist() for x in find_runs(ids, sizes)))) == expected


def test_hashes_that_lie_are_found_out(monkeypatch):
    made = []

    class Lying(periods._Hashes):
        def __init__(self, ids, seed):
            made.append(seed)
            super().__init__(ids if seed else np.zeros_like(ids), seed)

    monkeypatch.setattr(periods, "_Hashes", Lying)
    ws = np.array([0, 1, 2] * 12 + [3, 4, 5, 6, 7], np.int64)
    assert list(zip(*(x.tolist() for x in find_runs(ws, np.array([len(ws)]))))) == [(0, 0, 36, 3)]
    assert made == [0, 1]


def test_rows_of_the_contract(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["la", "le", "lo"]) for _ in range(draw.randint(0, 120)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "a b " * 20), (203, "x " * 5000), (203, "x " * 5000), (204, "é\x0bñ\x85 " * 30), (205, "a b c " * 8 + "d e " * 12)]
    rows += [(i, "one two three four five six " * 30 + f"{i}") for i in range(300, 360)]  # some are rewritten
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    key = lambda r: tuple((x is not None, x) for x in r)
    expected = sorted((brute_row(*r) for r in rows), key=key)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as start", "2 as n_words", "'x' as runs")
    assert sorted((tuple(r) for r in op13_periodic_runs(docs).collect()), key=key) == expected
    monkeypatch.setattr(periods, "BATCH_BYTES", 64)
    monkeypatch.setattr(periods, "WRITTEN", 7)
    for i, text in rows[:125:5]:
        ((n, runs, collapsed),) = periods._of_texts([(text or "").encode()])
        ws = (text or "").split()
        assert (n, runs) == (len(ws), brute_runs(ws))
        gone = {k for s, m, p in runs for k in range(s + p, s + m)}
        assert collapsed.decode() == " ".join(w for k, w in enumerate(ws) if k not in gone)


def test_general_interface_and_empty_table(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("k", "start " + "a b " * 12 + "end")], "url string, body string")
    row = periodic_runs(docs, F.col("body"), "url").first()
    assert row.asDict(recursive=True) == {"url": "k", "n_words": 26, "runs": [{"start": 1, "length": 24, "period": 2}], "collapsed": "start a b end"}
    assert op13_periodic_runs(spark.createDataFrame([], DOCS)).collect() == []
