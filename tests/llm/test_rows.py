"""Repeated rows, null ids, near copies, very long texts and ties, each with its defined result."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from slatebed.llm import bpe, dac, ppm, quality, simhash, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_quality_judges_each_row(spark):
    good = prose(random.Random(1), 40)
    kept = quality.keep_good(docs_of(spark, [(1, "bad"), (1, good), (None, good), (None, "bad")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, good), (1, good)]


def test_near_copies_leave_one_row(spark):
    rng = random.Random(2)
    texts = [prose(rng, 150) for _ in range(4)]
    words = texts[0].split()
    near = list(words)
    near[75] = "changed"  # five of 146 shingles: similarity 0.93
    far = [w if i % 10 else "other" for i, w in enumerate(words)]
    rows = [(5, texts[0]), (5, texts[0]), (5, texts[0]), (9, " ".join(near)), (2, " ".join(far)), (6, texts[1]), (7, texts[2]), (None, texts[2]), (8, texts[3].upper()), (3, texts[3])]
    kept = simhash.keep_one_per_component(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 5, 6, 7]


def test_a_null_id_links(spark, monkeypatch):
    fps = {"a": 0, "b": 3, "c": 15}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: spark.createDataFrame([(1, 0), (None, 3), (2, 15)], "doc_id long, fp long"))
    got = simhash.simhash_components(spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert len(fps) == len(got) and {r.component_id for r in got} == {1}


def test_long_pieces_take_the_same_merges():
    import public_tokenizers as public

    model = bpe.ByteBpe(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    rng = random.Random(7)
    for alphabet in ("a", "ab", "0123456789=", "etaoin shrdlu", "é€a"):
        piece = "".join(rng.choice(alphabet) for _ in range(300)).encode()
        assert model._merge_long(piece).tolist() == model._merge_rows([piece])[0].tolist()


def test_marginals_of_long_texts_are_those_of_one_chain():
    rng = np.random.default_rng(3)
    sizes, moves = np.array([700, 3, 257, 256]), np.log([[0.9, 0.1], [0.4, 0.6]])
    e = rng.normal(size=sizes.sum())
    found, at = toxicity.marginals(e, sizes, moves), 0
    for n in sizes:
        f, b = toxicity.chain(np.exp(e[at : at + n])[None], moves)
        assert np.allclose(found[at : at + n], (f * b / (1 + f * b))[0])
        at += n


def test_scores_of_long_texts_are_those_of_their_pieces(spark, monkeypatch):
    text = prose(random.Random(5), 400)
    pieces = list(ppm._pieces(text))
    monkeypatch.setattr(ppm, "LAID", 300)
    cut = list(ppm._pieces(text))
    assert len(pieces) == 1 and len(cut) > 5 and "".join(t for t, _, _ in cut) == text and [z for _, _, z in cut][-1]
    whole, _ = ppm._codes([text.encode()])
    parts, _ = ppm._codes([t.encode() for t, _, _ in cut], [h for _, h, _ in cut], [z for _, _, z in cut])
    assert whole.tolist() == parts.tolist()


def test_token_files_with_ties_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(dac, "SHARD_TOKENS", 7)
    rows = [(3, "the cat"), (3, "a dog."), (None, "x"), (None, "Über, naïve <|endoftext|>"), (1, None), (3, "the cat")]
    first, again = (sorted((r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in dac.op5_dac_tokens(docs_of(spark, some)).collect()) for some in (rows, rows[::-1]))
    assert first == again and sorted(s for _, s, _, _ in first)[0] == 0
    ends = sorted((s, s + n) for _, s, n, _ in first)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert zlib.crc32(np.array([2], "<u4").tobytes()) in {c for i, _, n, c in first if i == 1}


def test_paths_of_any_depth_are_told_apart(spark):
    deep = "/a/b/c/d/e/f/g/"
    rows = [(i, f"https://h.net{deep}{'x' if i % 2 else 'y'}/{i}", "") for i in range(6)]
    got = urls.op10_url_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.template for r in got} == {f"{deep}x/*/", f"{deep}y/*/"}


@pytest.mark.parametrize("master", ["local[2]", "local"])
def test_local_sessions_may_lack_a_folder(master):
    import re

    assert re.fullmatch(r"local(\[[^]]*\])?", master) and not re.fullmatch(r"local(\[[^]]*\])?", "local-cluster[2,1,1024]")
