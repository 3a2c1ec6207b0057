"""The ten operators against brute force, and on odd tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from slatebed.llm import bpe, dac, imatch, mixing, ppm, quality, simhash, substrings, toxicity, urls
from slatebed.llm.lyndon import suffix_arrays

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made_texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(80), prose(12)
    texts: list[str | None] = [prose(rng.randrange(1, 120)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[4] + " end", prose(30) + " " + passage + " " + prose(20), passage, prose(5) + "\n" + passage]
    texts += ["\n".join([line] * 30), None, "", "   \n\t ", "a" * 700, "x y", "Ünï 😀 çode " * 60, prose(3000), prose(3000)[:9000]]
    return texts


TEXTS = made_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# -- 1 byte-level BPE


def test_bpe_is_that_of_the_library(docs, empty):
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.op1_byte_bpe(docs))
    for i, text in enumerate(TEXTS):
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        row = got[i * 3]
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.op1_byte_bpe(empty).count() == 0


def test_bpe_rows_and_heap_agree():
    import public_tokenizers as public

    model = bpe.ByteBpe(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    rng = random.Random(1)
    rows = ["".join(rng.choice("aabcé the") for _ in range(rng.randrange(2, 60))).encode() for _ in range(50)]
    assert [r.tolist() for r in model._merge_rows(rows)] == [model._merge_long(r).tolist() for r in rows]


# -- 2 document fingerprints


def test_imatch_edits_and_likeness(docs, empty):
    rows = sorted(imatch.op2_imatch(docs).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(TEXTS)
    for i, row in enumerate(rows):
        text, after = TEXTS[i] or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
        if edited == text:
            assert row.near_edited == 1
    equal = defaultdict(set)
    for i, row in enumerate(rows):
        equal[TEXTS[i] or ""].add(row.fingerprint)
    assert all(len(f) == 1 for f in equal.values())
    assert rows[3].fingerprint == rows[40].fingerprint and rows[3].fingerprint != rows[5].fingerprint
    assert imatch.op2_imatch(empty).count() == 0


def test_imatch_one_row_follows_itself(spark):
    row = imatch.op2_imatch(spark.createDataFrame([(7, "abcd", "en", "s", 4)], SCHEMA)).collect()
    assert [(r.doc_id, r.edited_sha256) for r in row] == [(7, hashlib.sha256(b"abab").hexdigest())]


# -- 3 suffix arrays


def test_suffix_arrays_match_sorting():
    rng = np.random.default_rng(3)
    for _ in range(60):
        strings = [np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)), 0) for _ in range(rng.integers(1, 5))]
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        found = suffix_arrays(np.concatenate(strings).astype(np.int64), bounds)
        for s, a, b in zip(strings, bounds, bounds[1:]):
            assert (found[a:b] - a).tolist() == sorted(range(len(s)), key=lambda i: tuple(s[i:]))


def removed_by_force(texts: list[bytes]) -> list[np.ndarray]:
    w = substrings.WINDOW
    seen = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                cover[i : i + w] = True
        out.append(cover)
    return out


@pytest.mark.parametrize("crowded", [24, 1])
def test_repeats_match_brute_force(docs, monkeypatch, crowded):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    got = by_id(substrings.op3_suffix_dedup(docs))
    texts = [(t or "").encode() for t in TEXTS]
    for i, (t, gone) in enumerate(zip(texts, removed_by_force(texts))):
        row = got[i * 3]
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_long_texts_are_cut_in_pieces(monkeypatch):
    data = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    monkeypatch.setattr(substrings, "PIECE", 1 << 11)
    substrings._powers.cache_clear()
    starts = [(low, high) for _, _, low, high in substrings.segments(data)]
    covered = np.concatenate([np.arange(a, b + 1) for low, high in starts for a, b in zip(low, high)])
    substrings._powers.cache_clear()
    assert sorted(covered.tolist()) == list(range(5000 - substrings.WINDOW + 1))


def test_repeats_on_odd_tables(spark, empty):
    assert substrings.op3_suffix_dedup(empty).count() == 0
    twice = spark.createDataFrame([(1, "ab" * 150, "en", "s", 300)] * 2 + [(None, "short", "en", "s", 5)], SCHEMA)
    rows = substrings.op3_suffix_dedup(twice).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 300), (1, 300)]


# -- 4 toxicity


def test_chain_matches_enumeration():
    rng = np.random.default_rng(2)
    odds, moves = np.exp(rng.normal(size=(3, 5))), rng.normal(size=(2, 2))
    f, b = toxicity.chain(odds, moves)
    for d in range(3):
        weight = np.zeros((5, 2))
        for path in np.ndindex(*(2,) * 5):
            w = np.prod([odds[d, t] if s else 1.0 for t, s in enumerate(path)]) * np.exp(sum(moves[x, y] for x, y in zip(path, path[1:])))
            for t, s in enumerate(path):
                weight[t, s] += w
        assert np.allclose(weight[:, 1] / weight[:, 0], f[d] * b[d])


def test_marginals_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    sizes = np.array([3, 0, 50, 7, 4])
    e, moves = rng.normal(size=sizes.sum()), np.log([[0.9, 0.1], [0.4, 0.6]])
    whole = toxicity.marginals(e, sizes, moves)
    at = 0
    for n in sizes:
        assert np.allclose(whole[at : at + n], toxicity.marginals(e[at : at + n], np.array([n]), moves))
        at += n


def test_toxic_words_are_found(spark, empty):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            t.insert(rng.randrange(len(t)), rng.choice(["nasty", "Vile,", "rotten"]))
        texts.append(" ".join(t))
        labels.append(int(bad))
    model = toxicity.fit(texts[:300], labels[:300])
    out = list(toxicity.Scorer(model)([*texts[300:], ""]))
    right = [(s >= 0.5) == bool(y) for (s, _), y in zip(out, labels[300:])]
    assert np.mean(right) > 0.97 and out[-1][0] < 0.5
    spans = [texts[300][a:b] for a, b in out[0][1]]
    assert set(" ".join(spans).lower().replace(",", "").split()) <= {"nasty", "vile", "rotten"} and spans
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.op4_crf_toxicity(empty, none).count() == 0
    odd = spark.createDataFrame([(1, None, "en", None, 0), (None, "", "en", "s", 0)], SCHEMA)
    assert all(0 <= r.score <= 1 for r in toxicity.op4_crf_toxicity(odd, none).collect())


# -- 5 token files


def test_dac_gives_any_token():
    rng = np.random.default_rng(6)
    for n in (0, 1, 511, 513, 3000):
        ids = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 31, n, dtype=np.uint64)).astype(np.uint32)
        coded = dac.Dac(dac.dac_encode(ids))
        assert (coded.all() == ids).all()
        assert [coded[i] for i in range(0, n, 17)] == ids[::17].tolist()


def test_token_files_match_the_library(docs, empty):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = by_id(dac.op5_dac_tokens(docs))
    start = 0
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        row = got[i * 3]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert dac.op5_dac_tokens(empty).count() == 0


# -- 6 quality


def test_quality_counts_match_brute_force(docs, empty):
    got = by_id(quality.op6_host_quality(docs))
    for i, text in enumerate(TEXTS):
        text = text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        row = got[i * 3]
        assert (row.n_words, row.word_chars, row.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (row.base_failed and row.kept)
    assert quality.op6_host_quality(empty).count() == 0


def test_bad_hosts_lose_their_documents(spark):
    rows = [(i, "short" if i % 10 else "a fine text of more than ten words is kept if its host is", "en", "bad", 0) for i in range(100)]
    rows += [(i, "a fine text of more than ten words is kept if its host is", "en", f"good{i % 5}", 0) for i in range(100, 400)]
    got = by_id(quality.op6_host_quality(spark.createDataFrame(rows, SCHEMA)))
    assert not any(r.kept for i, r in got.items() if i < 100) and all(r.kept for i, r in got.items() if i >= 100)


# -- 7 language model scores


def test_ppm_is_a_distribution():
    texts = [b"abracadabra", b"abrakadabra", b"banana band", b""] * 3
    codes = np.concatenate([ppm._codes([t])[0] for t in texts])
    entries = []
    for k in range(ppm.ORDER + 1):
        part, n = np.unique(codes & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True)
        contexts, of = np.unique(part >> np.uint64(8), return_inverse=True)
        keep = n >= 2
        entries.append((part[keep], n[keep].astype(float), contexts, np.bincount(of, n).astype(float)))
    model = ppm.Ppm(entries)
    for context in (b"abra", b"zzz", b"", b"ban"):
        history = (bytes([ppm.START]) * ppm.ORDER + context)[-ppm.ORDER :]
        base = sum(b << (8 * (i + 1)) for i, b in enumerate(history[::-1]))
        chances = 10 ** model.log10(np.array([base | s for s in range(256)], np.uint64))
        assert 0.9 < chances.sum() <= 1 + 1e-9  # one symbol of 257 is no byte


def test_scores_match_brute_force(docs, empty):
    got = by_id(ppm.op7_ppm(docs))
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    train = [i for i in range(len(TEXTS)) if zlib.crc32(str(i * 3).encode()) % 7 != 2]
    counts = Counter(w for i in train for w in [*WORD.findall(lower(TEXTS[i])), None])
    n, v = sum(counts.values()), len(counts)
    for i, text in enumerate(TEXTS):
        tokens = [*WORD.findall(lower(text)), None]
        row = got[i * 3]
        assert row.held_out == (i not in train)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert row.base_score == pytest.approx(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
        assert row.score < 0
    assert ppm.op7_ppm(empty).count() == 0


# -- 8 SimHash


def by_force(fps: list[int], ids: list[int]) -> dict[int, int]:
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), 1 << 60), ids[i])
    return {ids[i]: least[find(i)] for i in range(len(fps))}


def test_simhash_matches_brute_force(docs, empty):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    fps = []
    for text in TEXTS:
        w = WORD.findall(lower(text))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    got = by_id(simhash.op8_simhash(docs))
    want = by_force(fps, [i * 3 for i in range(len(TEXTS))])
    for i in range(len(TEXTS)):
        assert (got[i * 3].fingerprint, got[i * 3].component_id) == (f"{fps[i]:016x}", want[i * 3])
    assert simhash.op8_simhash(empty).count() == 0


@pytest.mark.parametrize("crowded", [48, 2])
def test_links_lose_no_pair(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for _ in range(150):
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[find(e.a)] = find(e.b)
    want = by_force(fps, list(range(len(fps))))
    groups = defaultdict(set)
    for i, s in enumerate(signed):
        groups[find(s)].add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


# -- 9 mixing


def test_mix_reaches_its_targets(spark, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), "en", None if i % 20 == 0 else f"s{min(i % 13, 6)}", 0) for i in range(1500)]
    got = mixing.op9_entropy_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 1500 and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    sizes: dict = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text))
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target: dict = {}
    free, left = set(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    source_of = {r[0]: r[3] for r in rows}
    taken: dict = defaultdict(int)
    for r in got:
        taken[source_of[r.doc_id]] += r.taken
        assert r.source_size == sizes[source_of[r.doc_id]] and r.target == pytest.approx(target[source_of[r.doc_id]])
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 1 for s in names)
    again = {r.doc_id: r.taken for r in mixing.op9_entropy_mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.op9_entropy_mix(empty).count() == 0


# -- 10 URLs


def test_url_rules_and_templates(spark):
    given = {
        1: ("http://A.Example.org/es/7?x=1", "a.example.org", "/es/7", "example.org/es/", "block"),
        2: ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        3: ("https://example.org/en/22", "example.org", "/en/22", "org/", "allow"),
        4: ("https://x.com/de/1#t", "x.com", "/de/1", "com/de/", "block"),
        5: ("https://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
        6: ("https://org", "org", "", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("no address", "", "", None, "allow"),
    }
    rows = [(i, g[0], "") for i, g in given.items()]
    rows += [(100 + i, f"https://h{i % 7}.com/de/{i}", "") for i in range(60)] + [(200 + i, f"https://h{i % 7}.com/fr/{i}", "") for i in range(60)]
    rows += [(300, "https://other.net/de/5", ""), (301, "https://other.net/fr/5", "")]
    got = {r.page_id: r for r in urls.op10_url_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, g in given.items():
        assert (got[i].host, got[i].path, got[i].rule) == g[1:4]
        if g[3]:
            assert got[i].verdict == g[4]
    assert (got[300].rule, got[300].verdict, got[301].verdict) == (None, "block", "allow")
    assert got[300].template == "/de/*/"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.op10_url_templates(none).count() == 0


def test_segments_meet_only_those_that_may_share_a_string():
    """Texts with the same 64 bytes, of which few share 200, lose the same strings as if all were compared."""
    rng = np.random.default_rng(5)
    letters = lambda n: bytes(rng.integers(97, 101, n, dtype=np.uint8))
    gram = letters(64)
    key = int(substrings._Hashes(np.frombuffer(gram, np.uint8)).grams().view(np.int64)[0])
    lefts, rights = [letters(136) for _ in range(6)], [letters(136) for _ in range(6)]
    rows = []
    for i in range(120):
        a, b = int(rng.integers(20, 137)), int(rng.integers(20, 137))
        left, right = lefts[rng.integers(6)], rights[rng.integers(6)]
        cut, stop = int(rng.integers(0, 137)), int(rng.integers(0, 137))
        text = (letters(cut) + left[cut:])[136 - a :] + gram + (right[:stop] + letters(136 - stop))[:b]
        if len(text) >= 200:
            rows.append((key, i % 3 > 0, i, 0, 1000, text))
    assert len(rows) > 40

    def strings(groups):
        found = substrings.repeated_strings([[r[5] for r in group] for group in groups])
        return {(r[2], r[4] + int(s)) for group, starts in zip(groups, found) for r, of in zip(group, starts) if r[1] for s in of}

    met = substrings._with_partners(rows)
    assert strings(met) == strings([rows]) and strings(met)
    assert sum(len(r[5]) for group in met for r in group) < sum(len(r[5]) for r in rows)


def test_codes_of_a_chunk_are_counted_in_little_memory():
    """A chunk has a code of eight bytes for each of its bytes; asking never holds all of them."""
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in rng.integers(2, 9, 2000)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 2000, 300)) for _ in range(2500)]
    body = b"".join(texts)
    row = {"chunk": 3, "learn": True, "wanted": True, "uids": [0] * len(texts), "ids": [0] * len(texts), "sizes": [len(t) for t in texts]}
    row |= {"heads": [ppm._HEAD] * len(texts), "last": [True] * len(texts), "texts": len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)}
    batch = pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in ppm._LAID], schema=ppm._LAID)
    tracemalloc.start()
    asked = [r for b in ppm._ask_batches(4)(iter([batch])) for r in b.to_pylist() if r["codes"] is not None]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counted = {}
    for r in asked:
        counted |= dict(zip(ppm._unpack_sorted(r["codes"]).tolist(), ppm._unpack(r["times"], np.int64).tolist()))
    codes, times = np.unique(ppm._turned(ppm._codes(texts)[0]), return_counts=True)
    assert counted == dict(zip(codes.tolist(), times.tolist()))
    assert most < 18 * len(body)  # 23 when all were held
