"""The pipeline's stages on a small table, each against what it should do to its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from slatebed.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    texts = [prose(120) for _ in range(30)]
    texts += [texts[0], texts[1], prose(50) + " " + passage + " " + prose(50), prose(40) + " " + passage, "too short", None]
    return texts, passage, spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_stages(spark):
    texts, passage, docs = table(spark)
    stages = dict(corpus_pipeline.STAGES)
    good = stored(stages["quality_rules"](spark, docs, ""), "t")
    assert {r.doc_id for r in good.collect()} == set(range(34)) and good.columns == docs.columns
    single = stored(stages["simhash_near_duplicates"](spark, good, ""), "t")
    assert {r.doc_id for r in single.collect()} == set(range(34)) - {30, 31} and single.columns == docs.columns
    cut = stored(stages["suffix_array_dedup"](spark, single, ""), "t")
    left = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and all(left[i].text == texts[i] for i in range(30))
    assert all(passage[5:-5] not in left[i].text and left[i].n_chars == len(left[i].text) for i in (32, 33))
    mixed = stored(stages["source_mixing"](spark, cut, ""), "t")
    times = {i: 0 for i in left}
    for r in mixed.collect():
        times[r.doc_id] += 1
    assert mixed.columns == docs.columns and max(times.values()) <= 2
    tokens = stages["byte_bpe"](spark, mixed, "")
    assert tokens.count() == mixed.count()


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_clashing_columns_and_hot_source(spark):
    wide = SCHEMA + ", key long, seg long, th long, row string, spans string, component_id long, fp long, kept boolean, copies long, size long"
    rows = [(i, f"text number {i} " * 40, "en", "hot", 9, 1, 2, 3, "r", "s", 4, 5, True, 6, 7) for i in range(12)]
    docs = spark.createDataFrame(rows, wide)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stored(stage(spark, docs, ""), "t")
        assert docs.columns == [c.split()[0] for c in wide.split(", ")]


def test_first_and_last_stage_with_clashing_columns(spark):
    """Rows that repeat are judged and encoded each; nulls fail the rules and have no tokens."""
    import hashlib

    names = "host string, base_failed boolean, rejected boolean, uid long, ids string, _text string, _words string"
    prose = " ".join(f"word{i}" for i in range(30))
    rows = [(i, t, "en", s, 1, "h", True, True, 1, "x", "t", "w") for i, t, s in ((1, prose, None), (1, prose, None), (2, None, "a"), (None, prose + " more", "a"), (3, "", "a"))]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {names}")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, "")
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    tokens = sorted(stages["byte_bpe"](spark, docs, "").collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert [r.doc_id for r in tokens] == [None, 1, 1, 2, 3] and [r.n_tokens for r in tokens][-2:] == [0, 0]
    assert tokens[1].decoded_sha256 == hashlib.sha256(prose.encode()).hexdigest() and tokens[1] == tokens[2]
