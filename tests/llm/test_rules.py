"""The rule ensemble: compiled scores, held-out accuracy and odd tables."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from slatebed.llm import rules
from slatebed.llm.rules import Limit, RuleEnsemble, op12_rule_ensemble

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9)))
    rows, labels = [], []
    for i in range(900):
        ws = [word() for _ in range(draw.randint(20, 150))]
        bad = i % 4 == 0
        if bad:
            ws = [w + "$$$" for w in ws] if i % 8 else [w for w in ws[:6] for _ in range(9)]
        rows.append((i, " ".join(ws)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_documents_are_told_apart_and_their_labels_never_seen(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in op12_rule_ensemble(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    right = [got[i].predicted == q for i, q, _ in labels if held(i)]
    assert len(right) > 200 and np.mean(right) > 0.98
    turned = [(i, 1 - q if held(i) else q, 1) for i, q, _ in labels]
    again = op12_rule_ensemble(docs, spark.createDataFrame(turned, LABELS)).collect()
    assert {r.doc_id: r.score for r in again} == {i: r.score for i, r in got.items()}


def test_the_column_is_the_ensemble(spark):
    rows, labels = corpus()
    model = rules.learn(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert 0 < len(model.rules) < 200  # sparse
    docs = spark.createDataFrame(rows[:50] + [(-1, None), (-2, ""), (-3, "\n\n"), (-4, "x " * 30000)], DOCS)
    stats, names = rules.with_statistics(docs, [F.col("doc_id")], F.col("text"))
    for r in stats.withColumn("score", model.column()).collect():
        assert all(r[n] is not None and math.isfinite(r[n]) for n in names)
        odds = model.bias + sum(w for limits, w in model.rules if all((r[x.name] > x.at) == x.over for x in limits))
        odds += sum(w * min(max(r[n], low), high) for n, low, high, w in model.lines)
        assert abs(r.score - 1 / (1 + math.exp(-odds))) < 1e-9


def test_statistics_of_known_texts(spark):
    stats, names = rules.with_statistics(spark.createDataFrame([(1, "Ab ab ab! 7|x\n\nAb ab ab! 7|x")], DOCS), [], F.col("text"))
    r = stats.first()
    assert math.isclose(r.log_words, math.log1p(8)) and r.distinct_words == 4 / 8 and r.repeats_before == 0
    assert r.lines_a_word == 2 / 8 and r.distinct_lines == 0.5 and r.bangs_a_word == 2 / 8 and r.bars_a_word == 2 / 8
    assert math.isclose(r.upper, 2 / 28) and math.isclose(r.digits, 2 / 28) and r.short_words == 4 / 8


def test_paths_that_hold_for_the_same_rows_are_one_rule_and_noise_gets_none():
    draw = np.random.default_rng(0)
    x = draw.random((600, 3))
    model = rules.fit(["a", "b", "c"], x, (x[:, 0] > 0.5).astype(int))
    assert any(limits == (Limit("a", limits[0].at, limits[0].over),) and abs(limits[0].at - 0.5) < 0.03 for limits, _ in model.rules)
    noise = rules.fit(["a", "b", "c"], x, draw.integers(0, 2, 600))
    assert len(noise.rules) <= 3


def test_odd_tables(spark):
    rows, labels = corpus()
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert op12_rule_ensemble(empty, none).collect() == []
    odd = [(None, None), (None, "a b"), (5, "same"), (5, "same"), (6, ""), (7, "word " * 50000)]
    docs = spark.createDataFrame(odd, DOCS).selectExpr("*", "'x' as score", "1 as quality", "array('y') as log_words")
    plain = op12_rule_ensemble(docs, none)
    assert plain.columns == ["doc_id", "held_out", "score", "predicted"]
    assert [r.score for r in plain.collect()] == [0.5] * len(odd)
    one_label = spark.createDataFrame([(i, 1, None) for i in range(30)] + [(None, 0, 0), (5, None, 0)], LABELS)
    assert {r.predicted for r in op12_rule_ensemble(docs, one_label).collect()} == {1}
    # the worst of several labels counts, as if it were the only one
    both = spark.createDataFrame(labels + [(i, 1, 0) for i, q, _ in labels if q == 0] + [(i, None, 0) for i, *_ in labels], LABELS)
    whole = spark.createDataFrame(rows, DOCS)
    assert rules.learn(whole, both) == rules.learn(whole, spark.createDataFrame(labels, LABELS))
    # repeated rows of a document are one in learning and rows of their own in the result
    assert rules.learn(whole.union(whole), both) == rules.learn(whole, both)


def test_the_sample_is_bounded(spark, monkeypatch):
    rows, labels = corpus()
    monkeypatch.setattr(rules, "MOST_OF_LABEL", 40)
    seen = []
    monkeypatch.setattr(rules, "fit", lambda names, x, y: seen.append((x.shape, y.tolist())) or RuleEnsemble(0.0))
    labels += [(10**6 + i, i % 2, 0) for i in range(500)]  # without documents
    rules.learn(spark.createDataFrame(rows + [(1, f"another text {i}") for i in range(100)], DOCS), spark.createDataFrame(labels, LABELS))
    assert seen == [((80, 19), [0] * 40 + [1] * 40)]
