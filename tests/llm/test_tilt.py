"""The rates of the mix against the optimum found by bisection."""

from __future__ import annotations

import math
import random

from slatebed.llm import mixing


def optimum(sizes: list[int], target: float) -> list[float]:
    """min(2, exp(t * size / mean)) with the t at which the rates take the target."""
    mean = sum(sizes) / len(sizes)
    rates = lambda t: [min(2.0, math.exp(min(1.0, t * s / mean))) for s in sizes]
    low, high = -700.0, 700.0
    for _ in range(200):
        t = (low + high) / 2
        low, high = (t, high) if sum(s * r for s, r in zip(sizes, rates(t))) < target else (low, t)
    return rates(t)


def test_rates_are_the_optimum(spark):
    rng = random.Random(5)
    counts = {"a": 60, "b": 150, "c": 40, "d": 90, None: 30}
    rows = [(source, "w " * int(rng.lognormvariate(3, 1) + 1)) for source, n in counts.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.op9_entropy_mix(docs).collect()}
    assert len(got) == len(rows)
    tilted = 0
    for source in counts:
        mine = [got[i] for i, (s, _) in enumerate(rows) if s == source]
        if mine[0].target >= 2 * mine[0].source_size * (1 - mixing.TOLERANCE):
            assert all(r.rate == 2 for r in mine)
            continue
        tilted += 1
        for r, best in zip(mine, optimum([r.size for r in mine], mine[0].target)):
            assert abs(r.rate - best) < 0.01, (source, r, best)
    assert tilted >= 2
