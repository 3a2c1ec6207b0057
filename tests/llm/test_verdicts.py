"""Hosts that decide, and samples that one long text doesn't empty."""

from __future__ import annotations

import random

import duckdb

from slatebed.llm import quality, toxicity
from slatebed.llm.oracles import QUALITY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_hosts_decide_either_way_and_documents_rules_are_evidence_only(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1200):
        source = None if i % 20 == 19 else f"src{i % 20}"
        bad = rng.random() < (0.85 if source == "src3" else 0.75 if source is None else 0.12)
        text = prose(rng, 40)
        if bad and source == "src3":
            text = text.replace(" ", " $$ ")
        elif bad and source is None:
            text = "\n".join([prose(rng, 12)] * 1 + [line := prose(rng, 2)] + [line] * 5 + [prose(rng, 12)])
        elif bad:
            text = rng.choice([text.replace(" ", " ## "), "too short"])
        rows.append((i, text, "en", source, len(text)))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality.op6_host_quality(df).collect()}
    of = {i: s for i, _, _, s, _ in rows}
    assert {of[i] for i, r in got.items() if r.rejected} == {"src3", None}
    assert all(r.kept == (not r.base_failed and not r.rejected) for r in got.values())
    clean = lambda i: rows[i][1].count(" ") == 39 and "$" not in rows[i][1]
    assert any(clean(i) and not r.kept for i, r in got.items() if of[i] == "src3")  # the host's verdict
    assert any("##" in rows[i][1] and r.kept for i, r in got.items())  # a document's own failure isn't one
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841  read by name below
    con.register("documents", documents)
    want = con.execute(QUALITY).df()
    cells = lambda frame: sorted(map(repr, frame[sorted(frame.columns)].round(6).values.tolist()))
    assert cells(quality.op6_host_quality(df).toPandas()) == cells(want)


def test_hosts_that_differ_by_chance_are_kept(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 30) if rng.random() < 0.8 else "short", "en", f"h{i % 15}", 0) for i in range(900)]
    got = quality.op6_host_quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert not any(r.rejected for r in got) and sum(r.kept for r in got) == sum(t != "short" for _, t, *_ in rows)


def test_a_text_over_the_sample_s_bytes_is_passed_over(spark, monkeypatch):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        bad = i % 2
        rows.append((i, prose(rng, 25) + (" zzvile zzvile" if bad else "")))
        labels.append((i, 1, bad))
    rows += [(i, prose(rng, 4000)) for i in range(240, 260)]  # each over the bound
    labels += [(i, 1, i % 2) for i in range(240, 260)]
    monkeypatch.setattr(toxicity, "MOST_BYTES", 16000)
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any("zzvile" in f for f in model.weights)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert min(scores[i] for i in range(1, 240, 2)) > max(scores[i] for i in range(0, 240, 2))
