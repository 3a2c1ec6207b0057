"""The prefix trie against one that is built node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from slatebed.llm import prefix_trie
from slatebed.llm.prefix_trie import DIGEST, NO_ENDS, TrieBuilder, common_turns, op11_prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def brute_rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[c].append(((turn is not None, turn or 0), role, digest, text))
    plain = {c: [(t[1], t[3]) for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = plain.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute_trie(sequences):
    """``{conv_id: tuple of (turn, bytes)}`` to the contract's rows."""
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    rows = []

    def walk(node):
        leaves, saved = int(not children[node]), (len(members[node]) - 1) * (node[-1][1] if node else 0)
        for child in children[node]:
            x, y = walk(child)
            leaves, saved = leaves + x, saved + y
        ends = ",".join(map(str, sorted(c for c in members[node] if len(sequences[c]) == len(node))))
        rows.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(rows, key=str)


def brute(rows):
    return brute_trie({c: [(t, len(t[1].encode())) for t in seq] for c, seq in brute_rebuilt(rows).items()})


def digest(turn):
    return hashlib.md5(str(turn).encode()).digest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=25), st.lists(st.integers(1, 24), max_size=6))
def test_parts_sum_up_to_the_trie(conversations, cuts):
    size = lambda turn: turn * 3 + 1
    kinds = defaultdict(list)
    for c, turns in enumerate(conversations):
        kinds[tuple(turns)].append(c)
    ordered = sorted((b"".join(map(digest, t)), t) for t in kinds)
    parts = [ordered[a:b] for a, b in zip([0, *sorted(cuts)], [*sorted(cuts), len(ordered)]) if ordered[a:b]]
    rows = []
    for k, part in enumerate(parts):
        builder = TrieBuilder(parts[k - 1][-1][0] if k else None)
        for seq, turns in part:
            ids = kinds[turns]
            builder.add(seq, [size(t) for t in turns], len(ids), min(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        builder.finish(parts[k + 1][0][0] if k + 1 < len(parts) else None)
        rows += builder.rows
    shared, whole = {}, []
    for r in rows:
        if r[8] is not None:
            old = shared.get(r[8])
            shared[r[8]] = (min(old[0], r[0]), r[1], None, *(a + b for a, b in zip(old[3:7], r[3:7])), old[7] or r[7], r[8], r[9]) if old else r
    for r in [r for r in rows if r[8] is None] + list(shared.values()):
        whole.append((r[0], r[1], shared[r[9]][0] if r[9] is not None else r[2], *r[3:7], r[7] or NO_ENDS))
    expected = brute_trie({c: [(t, size(t)) for t in turns] for c, turns in enumerate(conversations)})
    assert sorted(whole, key=str) == expected


def test_common_turns():
    a = bytes(range(64))
    assert common_turns(a, a) == 4 and common_turns(a, b"") == 0
    assert common_turns(a, a[:40] + b"x" * 24) == 2 and common_turns(a, a[:32]) == 2 and common_turns(b"x" * DIGEST, a) == 0


def made_rows():
    draw = random.Random(4)
    greeting = [("system", "be kind"), ("user", "hello é")]
    rows = []
    for c in range(120):
        turns = (greeting if c % 3 else []) + [(draw.choice(["user", "assistant"]), draw.choice("abc")) for _ in range(draw.randint(0, 6))]
        if c % 4 == 0:  # many copies
            turns = [*greeting, ("assistant", "yes"), ("user", "thanks")] * 2
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(500, None, "user", "first"), (500, 0, None, "x"), (500, 0, None, None), (500, 0, "user", None), (500, 0, "user", None), (None, 0, "user", "lost")]
    rows += [(1000 + i, j, "user", "the same") for i in range(7) for j in range(40 + i)]
    rows += [(2000, i, "user", f"turn {i}") for i in range(900)] + [(2001, i, "user", f"turn {i}") for i in range(700)]
    draw.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rows_of_the_contract(spark, monkeypatch):
    rows = made_rows()
    docs = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 as n", "'x' as seq", "2 as depth", "'k' as key")
    found = op11_prefix_trie(docs)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(found) == brute(rows)
    monkeypatch.setattr(prefix_trie, "FEW_SHARED", 0)  # joined by a shuffle
    monkeypatch.setattr(prefix_trie, "BATCH", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        assert got(op11_prefix_trie(docs)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_few_conversations(spark):
    make = lambda rows: op11_prefix_trie(spark.createDataFrame(rows, CONVERSATIONS))
    assert got(make([])) == []
    assert got(make([(None, 1, "user", "a")])) == []
    rows = [(7, 0, "user", "a")]
    assert got(make(rows)) == brute(rows)
    # turnless: its own turn comes before the ones it keeps, and the base is absent
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(c, 0, "user", "a")]
    assert got(make(rows)) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_ids_of_many_members_stream_past(spark):
    rows = [(5 * i, 0, "user", "same") for i in range(25000)] + [(3, 0, "user", "same")]
    assert got(op11_prefix_trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(7))) == brute(rows)
