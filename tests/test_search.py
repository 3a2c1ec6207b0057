"""Search by index, sketches, block lists, scrubbing and exports."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from slatebed.operators import audit, checks, docsearch, extract, health


def made_docs():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    docs = [(i, " ".join(word() for _ in range(3)), "\n".join([" ".join(word() for _ in range(12)), "## " + word() + " " + word(), " ".join(word() for _ in range(6))])) for i in range(150)]
    return docs + [(900, None, "only body ab"), (901, "TITLE ab", None), (902, "", ""), (903, "É ab", "x" * 3000 + "cab")]


def test_each_query_finds_what_a_scan_finds(spark):
    docs = spark.createDataFrame(made_docs(), "doc_id long, title string, body string")
    index = docsearch.postings(docs)
    texts = ["ab", "a b", "abc e", "Cab AB", "bb bb a", "nothingatall", "", None, "é", "dead", "e d c b a"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got: dict = {}
    for r in docsearch.search(asked, index, docsearch.pieces(index), docsearch.texts(docs)).collect():
        got.setdefault(r.query_id, []).append((r.place, r.doc_id, r.score))
    for i, text in enumerate(texts):
        want = [(k + 1, r.doc_id, r.score) for k, r in enumerate(extract.doc_scores(docs, text or "").collect())]
        assert sorted(got.get(i, [])) == want, text
    none = docsearch.postings(docs.limit(0))
    assert docsearch.search(asked, none, docsearch.pieces(none), docsearch.texts(docs.limit(0))).collect() == []


def test_merged_sketches_stay_within_their_bound(spark):
    rng = random.Random(2)
    rows = [(60 * i, f"p{i % 3}", rng.random() < 0.9, rng.lognormvariate(3, 1)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "s long, provider string, ok boolean, duration double").withColumn("ts", F.timestamp_seconds("s"))
    windows = health.by_window(df, "1 hour")
    total = health.numbers(health.merged(windows, "provider")).collect()
    for r in total:
        mine = sorted(x[3] for x in rows if x[1] == r.provider)
        rank = sum(d <= r.p95 for d in mine) / len(mine)
        assert r.requests == len(mine) and abs(rank - 0.95) < 2 / health.K
        assert abs(r.error_rate - sum(not x[2] for x in rows if x[1] == r.provider) / len(mine)) < 1e-12
    small = health.numbers(windows).first()  # twenty values: exact
    inside = sorted(x[3] for x in rows if x[1] == small.provider and x[0] // 3600 * 3600 == small.window_start.timestamp())
    assert small.p95 in inside


def test_hosts_on_a_list_of_any_size(spark):
    urls = ["https://a.b.example/x", "http://b.example", "https://xb.example/", "https://c.example:8080/q", "https://d.c.example/", "nothing", None, "https://me:pw@E.example/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string")
    listed = spark.createDataFrame([("b.example", True), ("c.example", False), ("e.EXAMPLE", None)] + [(f"h{i}.example", True) for i in range(3000)], "host string, below boolean")
    assert sorted(r.id for r in checks.not_blocked(rows, "url", listed).collect()) == [2, 4, 5, 6]
    assert checks.not_blocked(rows, "url", listed.limit(0)).count() == len(urls)


def scrubbed(value, depth=0):
    """The rule in Python."""
    if depth > 6:
        return "[TRUNCATED]"
    if isinstance(value, str):
        return re.sub(r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]", value)
    if isinstance(value, list):
        return [scrubbed(v, depth + 1) for v in value]
    if isinstance(value, dict):
        return {k: "[REDACTED]" if re.search("(?i)" + audit.HIDDEN_KEY, k) else scrubbed(v, depth + 1) for k, v in value.items()}
    return value


def test_scrubbing_walks_any_json(spark):
    rng = random.Random(5)

    def made(depth):
        kind = rng.randrange(8 if depth < 9 else 5)
        if kind < 5:
            return rng.choice([None, True, 1, 2.5, "plain", "Bearer abc.def", 'q"\\ü\n', "", "x bearer  zz-1 y"])
        if kind == 5:
            return [made(depth + 1) for _ in range(rng.randrange(3))]
        return {rng.choice(["a", "b", "api_key", "My-Token", "é\"", "note", "in"]): made(depth + 1) for _ in range(rng.randrange(1, 4))}

    values = [made(0) for _ in range(150)] + [{"a": [[[[[[[1]]]]]]]}, {"in": {"in": {"in": {"in": {"in": {"in": {"in": 1}}}}}}}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "no json"), (901, None), (902, "")]
    got = {r.i: r.clean for r in spark.createDataFrame(rows, "i int, raw string").select("i", audit.scrub_json(F.col("raw")).alias("clean")).collect()}
    assert got[900] is got[901] is got[902] is None
    for i, v in enumerate(values):
        assert json.loads(got[i]) == scrubbed(v), json.dumps(v)


def test_csv_header_is_the_union_of_keys(spark):
    rows = spark.createDataFrame([(2, {"b": "x,y", "a": None}), (1, {"b": 'q"', "c": "line\nend"}), (3, None), (4, {})], "id long, record map<string,string>")
    lines = {r.n: r.line for r in checks.csv_table(rows, "record", "id").collect()}
    assert lines[0] in ("b,c,a",) and lines[1] == '"q""","line\nend",' and lines[2] == '"x,y",,' and lines[3] == lines[4] == ",,"
    assert checks.csv_table(rows.limit(0), "record", "id").collect() == []


def test_paths_and_keys(spark):
    one = spark.createDataFrame([(1,)], "x int")
    path = lambda base, p: checks.api_path(F.lit(base), F.lit(p), "api.service.example")
    cases = [("https://api.service.example", "search", "/v1/search"), ("https://API.service.example/v1/", "/search", "/search"), ("http://localhost:1", "/search", "/search"), ("https://api.service.example", "/usage", "/usage"), ("nothing", "/probe", "/probe"), ("https://api.service.example", "/v1/probe", "/v1/probe")]
    got = one.select(*(path(b, p).alias(str(i)) for i, (b, p, _) in enumerate(cases))).first()
    assert list(got) == [want for *_, want in cases]
    good = "k_" + "a" * 32
    tokens = [f"Bearer {good}", f" bearer   {good} ", f"Basic {good}", f"Bearer {good}a", "Bearer x" + good[1:], "", None]
    got = one.select(*(checks.bearer_token(F.lit(t).cast("string"), "k_").alias(str(i)) for i, t in enumerate(tokens))).first()
    assert list(got) == [good, good, None, None, None, None, None]
    assert one.select(checks.heading_id(F.lit(" What's new -- in 2_0? ")).alias("x")).first().x == "whats-new-in-2_0"


def test_short_terms_of_all_queries_are_found_in_one_pass_of_batches(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [7, 8, 9], "title": ["ab", "", ""], "heading": ["", "été", ""], "body": ["ab cab", "x été ab", ""], "brief": ["ab ét zz"] * 3})
    got = [r for b in docsearch._held_batches([batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in got] == [("ab", 7, True, False), ("ab", 8, False, False), ("ét", 8, False, True)]


def test_a_word_is_posted_once_with_its_places(spark):
    docs = spark.createDataFrame([(1, "Red fox", "red x.\n## Blue red\nfox Fox")], "doc_id long, title string, body string")
    got = sorted(map(tuple, docsearch.postings(docs).collect()))
    assert got == [("##", 1, False, False), ("blue", 1, False, True), ("fox", 1, True, False), ("red", 1, True, True), ("x.", 1, False, False)]
    plan = docsearch.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the words of a document are put together where it is
