"""The template tree against one that is grown segment by segment."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from math import sqrt

from slatebed.llm import urls
from slatebed.llm.urls import FEW_PAGES, FEWEST_LABELS, MANY_CHILDREN, PRIOR, REJECT, RULES, SIMILAR, op10_url_templates

SCHEMA = "page_id long, url string"


def split(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def brute(pages):
    """``page_id`` to host, path, rule, verdict, template and purity, by the words of the module."""
    about = {i: (*split(u), rule_of(*split(u))) for i, u in pages}
    urls_of = defaultdict(lambda: [0, 0, 0])
    for host, path, rule in about.values():
        row = urls_of[host, path]
        row[0] += 1
        row[1] += rule is not None
        row[2] += rule is not None and rule[1] == "block"
    parts = {k: ["*" if re.search(urls._IDENTIFIER, s) else s for s in k[1].split("/") if s] for k in urls_of}
    template = dict.fromkeys(urls_of, "/")
    for level in range(max(map(len, parts.values()), default=0)):
        children = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        here = [k for k in urls_of if len(parts[k]) > level]
        for k in here:
            for x in range(3):
                children[k[0], template[k]][parts[k][level]][x] += urls_of[k][x]
        names = {}
        for node, kinds in children.items():
            n, labelled, blocked = (sum(c[x] for c in kinds.values()) for x in range(3))
            rate = (blocked + 1) / (labelled + 2)
            for child, (_, own, bad) in kinds.items():
                apart = abs(bad - own * rate) / sqrt(rate * (1 - rate) * max(own, 1))
                names[node, child] = "*" if len(kinds) > MANY_CHILDREN and n / len(kinds) < FEW_PAGES else "~" if len(kinds) > 1 and own >= FEWEST_LABELS and apart <= SIMILAR else child
        for k in here:
            template[k] += names[(k[0], template[k]), parts[k][level]] + "/"
    leaves, hosts, shapes, total = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for k, (_, labelled, blocked) in urls_of.items():
        for sums in (leaves[k[0], template[k]], hosts[k[0]], shapes[template[k]], total):
            sums[0] += labelled
            sums[1] += blocked
    base = (total[1] + 1) / (total[0] + 2)
    smooth = lambda sums, prior: (sums[1] + PRIOR * prior) / (sums[0] + PRIOR)
    out = {}
    for i, (host, path, rule) in about.items():
        t = template[host, path]
        # a shape is smoothed towards the host that asks
        purity = smooth(leaves[host, t], smooth(shapes[t], smooth(hosts[host], base)))
        out[i] = (host, path, rule[0] if rule else None, rule[1] if rule else "block" if purity > REJECT else "allow", t, round(purity, 9))
    return out


def made(rng, n):
    pages = []
    for i in range(n):
        host = rng.choice(["a.example.org", "b.example.org", "EXAMPLE.org", "x.com", "shop.com", "z.net"])
        path = rng.choice(["/es/", "/en/1", "/en/2", "/fr/", "/de/", "/", "", "/blog/a/b/c/d/e/f/g/", "/p//q/"])
        path += rng.choice(["", f"{rng.randrange(10**6)}", f"item{rng.randrange(60)}", f"{rng.choice('ab')}/x/{rng.choice('cd')}", "same/end/of/path", "*/~/y"])
        pages.append((i, f"http://{host}{path}{rng.choice(['', '?q=1', '#x'])}"))
    return pages + [(n, None), (n + 1, "no host"), (n + 2, "http://"), (n + 3, "http://deep.net/" + "/".join(f"s{k}" for k in range(1200))), (n + 4, "http://deep.net/" + "/".join(f"s{k}" for k in range(900)) + "/other/end")]


def rows(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in df.collect()}


def test_templates_and_verdicts_by_brute_force(spark, monkeypatch):
    pages = made(random.Random(31), 1500)
    df = spark.createDataFrame(pages, SCHEMA)
    want = brute(pages)
    assert {w[4].count("*") > 0 for w in want.values()} == {True, False} and any("~" in w[4] for w in want.values())
    assert rows(op10_url_templates(df)) == want


def test_rounds_are_as_many_as_forks(spark, monkeypatch):
    rounds = []
    kept = urls.stored
    monkeypatch.setattr(urls, "stored", lambda df, name: rounds.append(name) or kept(df, name))
    pages = [(i, f"http://a.net/one/two/three/four/five/{'x' if i % 2 else 'y'}/six/seven/eight/{'/'.join(str(i) * 2)}") for i in range(20)]
    df = spark.createDataFrame(pages, SCHEMA)
    assert rows(op10_url_templates(df)) == brute(pages)
    assert rounds.count("children") <= 4  # paths of 13 segments
    rounds.clear()
    alone = [(1, "http://a.net/" + "/".join(f"s{k}" for k in range(2000)))]
    assert rows(op10_url_templates(spark.createDataFrame(alone, SCHEMA))) == brute(alone)
    assert rounds.count("children") == 1


def test_many_nodes_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urls, "FEW_NODES", 0)
    pages = made(random.Random(32), 200)[:202]
    assert rows(op10_url_templates(spark.createDataFrame(pages, SCHEMA))) == brute(pages)
