from __future__ import annotations

import os
import random

import pytest

import pytest

from slatebed.dims import CANDIDATE
from slatebed.operators import candidates as ops
from slatebed.operators.hashes import greedy_dedupe, hamming_links, hamming_pairs


def rows(spark, *given):
    base = dict.fromkeys(f.name for f in CANDIDATE)
    made = [base | {"query": "q", "ordinal": i, "url": f"https://x.example/{i}.jpg", "source": "s", "license": "CC0"} | g for i, g in enumerate(given)]
    return spark.createDataFrame(made, CANDIDATE)


def ordinals(df):
    return [r.ordinal for r in df.orderBy("position" if "position" in df.columns else "ordinal").collect()]


def test_license_beats_size(spark):
    df = rows(spark, {"license": "EDITORIAL_LICENSED", "width": 2000, "height": 2000}, {"license": "CC0", "width": 800, "height": 800}, {"license": "CC_BY", "width": 1600, "height": 1600})
    assert ops.pick_best(df).first().ordinal == 1


def test_open_only_drops_editorial(spark):
    df = rows(spark, {"license": "EDITORIAL_LICENSED"}, {"license": "PRESS_KIT_ALLOWLIST"})
    assert ops.rank_all(df, "open-only").count() == 0


def test_prefer_safe_keeps_unknown_last(spark):
    df = rows(spark, {"license": "UNKNOWN", "width": 4000, "height": 4000}, {"license": "CC_BY_SA", "width": 1000, "height": 1000})
    assert ordinals(ops.rank_all(df, "prefer-safe")) == [1, 0]


def test_minimum_width_passes_unknown(spark):
    df = rows(spark, {"width": 300, "height": 300}, {})
    assert ordinals(ops.minimum_size(df, 1000)) == [1]


def test_url_variants_collapse(spark):
    df = rows(spark, {"url": "https://x.example/a?w=200"}, {"url": "https://x.example/a?w=1600&q=80"}, {"url": "https://x.example/b"})
    assert ordinals(ops.dedupe_url(df)) == [0, 2]


def test_policy_names():
    assert ops.resolve_policy("safe-only") == "context-safe"
    assert ops.resolve_policy(None, require_safe_license=False) == "any"
    with pytest.raises(ValueError):
        ops.resolve_policy("none")


def test_watch_diff(spark):
    now, seen = rows(spark, {"url": "a"}, {"url": "b"}), rows(spark, {"url": "a"})
    assert [r.url for r in ops.new_since(now, seen).collect()] == ["b"]


def hashes(n, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64)]
    while len(out) < n:
        out.append(rng.choice(out) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) if rng.random() < 0.7 else rng.getrandbits(64))
    return [f"{h:016x}" for h in out]


def test_pairs_match_brute_force(spark):
    h = hashes(60, 1)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(h)], "ordinal long, phash string")
    got = {(r.hash_a, r.hash_b, r.distance) for r in hamming_pairs(df, 5).collect()}
    d = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a in set(h) for b in set(h) if a < b}
    assert got == {(a, b, n) for (a, b), n in d.items() if n <= 5}


def test_greedy_dedupe_matches_sequential_rule(spark):
    h = hashes(40, 2)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(h)] + [(99, None)], "ordinal long, phash string")
    kept = []
    for i, x in enumerate(h):
        if all((int(x, 16) ^ int(y, 16)).bit_count() > 6 for _, y in kept):
            kept.append((i, x))
    got = {r.ordinal for r in greedy_dedupe(df, 6, checkpoint=lambda d: d.persist()).collect()}
    assert got == {i for i, _ in kept} | {99}


@pytest.mark.parametrize("most", [1, 5, 6])
def test_pairs_of_every_radius_once_each(spark, monkeypatch, most):
    from slatebed.operators import hashes as module

    h = hashes(120, 10 + most) + ["ABCDEF0123456789", "short", None]
    df = spark.createDataFrame([(x,) for x in h], "phash string")
    low = {x.lower() for x in h if x and len(x) == 16}
    want = sorted((a, b, n) for a in low for b in low if a < b and (n := (int(a, 16) ^ int(b, 16)).bit_count()) <= most)
    assert sorted(map(tuple, hamming_pairs(df, most).collect())) == want
    monkeypatch.setattr(module, "CROWDED", 0)  # every key is cut further
    assert sorted(map(tuple, hamming_pairs(df, most).collect())) == want


def test_meetings_dont_grow_with_the_square_of_the_hashes(spark):
    from slatebed.operators import hashes as module

    def joined(rows):  # rows that the joins make, by their own filters
        df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in rows], "bits long")
        return module._meetings(df, 5).count()

    rng = random.Random(3)
    assert joined(rng.getrandbits(64) for _ in range(2_000)) <= 2
    assert joined(rng.getrandbits(64) for _ in range(20_000)) < 200  # a hundredth of the hashes
    # a crowd that shares a half is cut by quarters of the other: 137 of 65536 quarters are near
    assert joined((0xABCD << 32) | rng.getrandbits(32) for _ in range(4_000)) < 4_000**2 / 2 / 200


@pytest.mark.parametrize(("most", "keys"), [(0, 10), (5, 21), (6, 28), (7, 36)])
def test_keys_of_a_hash_are_few(spark, most, keys):
    from slatebed.operators import hashes as module

    count = module._count(most)
    df = spark.createDataFrame([(-1,), (5,)], "bits long")
    got = df.select(module.F.array_distinct(module._keys(module.F.col("bits"), 64 // count, count)).alias("k")).collect()
    assert [len(r.k) for r in got] == [keys, keys]


@pytest.mark.parametrize(("n", "shared"), [(20_000, ""), (3_000, "00abcdef")])
def test_keys_are_not_sent_through_the_driver(spark, n, shared):
    """They are 21 times the hashes, and more in a crowd, of which Spark knows nothing when it plans the joins."""
    from pyspark.sql import functions as F

    digits = F.lower(F.lpad(F.hex(F.xxhash64("id")), 16, "0"))
    df = spark.range(n).select(F.concat(F.lit(shared), F.substring(digits, 1, 16 - len(shared))).alias("phash"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1100k")  # a table of a few rows takes 1 MB
    try:
        assert (hamming_pairs(df, 5).count() > 0) == bool(shared)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_greedy_dedupe_sends_no_keys_through_the_driver(spark):
    from pyspark.sql import functions as F

    from slatebed.sources.shared import written

    df = spark.range(40_000).select(F.col("id").alias("ordinal"), F.lower(F.lpad(F.hex(F.xxhash64("id")), 16, "0")).alias("phash"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")  # the hashes take less, a page of 33 MB; their keys more
    try:
        assert greedy_dedupe(df, 6, checkpoint=lambda d: written(d, "dedupe")).count() == 40_000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("most", [0, 2, 3, 6, 7])
def test_pairs_in_crowds_match_brute_force(spark, most):
    rng = random.Random(most)
    # 1300 hashes with the first and last 16 bits in common, some near each other
    h = [0xABCD << 48 | rng.getrandbits(32) << 16 | 0x1234 for _ in range(1000)]
    h += [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, most + 3))) for x in h[:300]]
    want = {(f"{a:016x}", f"{b:016x}", n) for a in h for b in h if a < b and (n := (a ^ b).bit_count()) <= most}
    got = sorted(map(tuple, hamming_pairs(spark.createDataFrame([(f"{x:016X}",) for x in h], "phash string"), most).collect()))
    assert got == sorted(want)


def test_links_tie_all_rows_within_the_radius(spark):
    h = [*hashes(40, 5), "ABCDEF0123456789", "abcdef0123456789", "abcdef0123456788", *["0" * 16] * 6, None]
    df = spark.createDataFrame(list(enumerate(h)), "ordinal long, phash string")
    links = [tuple(r) for r in hamming_links(df, 5).collect()]
    first = {x.lower(): i for i, x in reversed(list(enumerate(h))) if x}
    near = lambda i, j: (int(h[i], 16) ^ int(h[j], 16)).bit_count()
    assert all((x, y, n) == (h[i].lower(), h[j].lower(), near(i, j)) for i, j, x, y, n in links)
    ties = {frozenset((i, j)) for i, j, *_ in links}
    assert len(ties) == len(links)
    for i in range(len(h) - 1):
        for j in range(i):
            a, b = first[h[i].lower()], first[h[j].lower()]
            tied = all(len(t) == 1 or t in ties for t in (frozenset((i, a)), frozenset((a, b)), frozenset((b, j))))
            assert tied == (near(i, j) <= 5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_documents_of_equal_hashes_are_linked(spark):
    """Also those of different texts: every document that isn't the only one or the first with its hash has a link."""
    from slatebed.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    first, others = {}, set()
    for r in QUERIES["fn_ahash_bytes"](spark, folder).orderBy("doc_id").collect():
        if (a := first.setdefault(r.phash, r.doc_id)) != r.doc_id:
            others.add((a, r.doc_id))
    assert others
    assert {(r.doc_a, r.doc_b) for r in QUERIES["jn_hamming_pairs"](spark, folder).where("distance = 0").collect()} == others


def test_pairs_beyond_the_radius_are_refused(spark):
    with pytest.raises(ValueError):
        hamming_pairs(spark.createDataFrame([], "phash string"), 8)


def test_places_of_a_total_order(spark):
    from pyspark.sql import functions as F

    from slatebed.operators.totals import numbered, running_total

    rng = random.Random(5)
    data = [(rng.choice(["all"] * 30 + ["b", None]), rng.randrange(20), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, k int, ordinal long, v int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = numbered(df, ["g"], [F.desc("k"), F.col("ordinal")]).collect()
        totals = running_total(df, ["g"], [F.desc("k"), F.col("ordinal")], F.col("v"), "used").collect()
        whole = numbered(df, [], [F.col("v"), F.col("ordinal")], "place").collect()
        # no task holds a whole group
        places = numbered(df.where("g = 'all'"), ["g"], [F.col("ordinal")])
        assert "RANGE" in places._jdf.queryExecution().toString().upper() or places.count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    used = 0
    for g in ("all", "b", None):
        rows, used = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2])), 0
        assert [(r.ordinal, r.position) for r in sorted((r for r in got if r.g == g), key=lambda r: r.position)] == [(r[2], i + 1) for i, r in enumerate(rows)]
        by_id = {r.ordinal: r.used for r in totals if r.g == g}
        for r in rows:
            used += r[3]
            assert by_id[r[2]] == used
    assert [r.ordinal for r in sorted(whole, key=lambda r: r.place)] == [r[2] for r in sorted(data, key=lambda r: (r[3], r[2]))]
    assert numbered(df.limit(0), ["g"], [F.col("ordinal")]).collect() == []
