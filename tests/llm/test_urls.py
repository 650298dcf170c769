"""URL filter: hosts, paths and given rules against brute force; mined rules against counted ones."""

import re
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from playerlytics.llm import catalog, urls

RULES = catalog.URL_RULES


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match("[^/?#]*", rest, re.S)[0])
    path = re.match("[^?#]*", rest[len(host):], re.S)[0]
    fits = [(len(r), r, v) for v, r in RULES for h, _, p in [r.partition("/")]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = ["https://a.EXAMPLE.com/en/1", "http://www.example.com/en/x?y#z", "http://com/", "http://com", "x://example.com?/en/", "no url",
        None, "", "http://", "a://b.net/es/#", "a://b.net/esx/", "q://fr.net/fr/1?://", "http://xcom/", "İ://É.NET/fr/", "http://h/\n/x",
        "http://a.com\n/", "https://user@www.example.com:80/en/", "a://b://c.com/", "http://example.com/EN/", "x" * 50_000, "http://" + "a/" * 20_000]


def test_hosts_paths_and_given_rules(spark):
    rows = [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])]
    df = spark.createDataFrame([(i, u, "<x>", "r") for i, u in rows], "page_id long, url string, html string, rule string")
    got = urls.judge(df, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[0] if r.page_id is None else URLS[r.page_id]
        host, path, rule, verdict = brute(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.judge(df.where("false"), RULES).count() == 0


def test_mined_rules_are_the_counted_ones(spark):
    data = []
    for i in range(400):
        bad = i % 4 == 0
        data.append((["h0:com", "h1:pills" if bad else f"h1:site{i % 3}", "p:#"] + (["k:ref"] if i % 5 == 0 else []), "block" if bad else "allow"))
    df = spark.createDataFrame(data, "tokens array<string>, label string")
    got = {(tuple(r["tokens"]), r["verdict"]): r for r in urls.mined_rules(df, 0.02, 0.9)}
    counts, sure = {}, {}
    for own, label in data:
        for n in range(1, len(own) + 1):
            for c in combinations(sorted(own), n):
                counts.setdefault(c, {}).setdefault(label, 0)
                counts[c][label] += 1
    for c, by in counts.items():
        for label, n in by.items():
            if n >= 8 and n / sum(by.values()) >= 0.9:
                sure[c, label] = (n / sum(by.values()), n)
    want = {k: v for k, v in sure.items() if not any(sure.get((k[0][:i] + k[0][i + 1:], k[1]), (-1,))[0] >= v[0] for i in range(len(k[0])))}
    assert set(got) == set(want)
    assert all((got[k]["confidence"], got[k]["support"]) == pytest.approx(want[k]) for k in want)
    assert urls.mined_rules(df.where("false")) == []


RULE = st.tuples(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=3, unique=True).map(sorted), st.sampled_from(["allow", "block"]),
                 st.sampled_from([0.8, 0.9, 1.0]), st.integers(1, 5))


@settings(max_examples=200, deadline=None)
@given(st.lists(RULE, max_size=12), st.lists(st.sampled_from("abcdef"), unique=True))
def test_the_index_finds_the_surest_rule(found, own):
    rules = [{"tokens": t, "verdict": v, "confidence": c, "support": s, "rarest": t[0]} for t, v, c, s in found]
    fit = [(-r["confidence"], -r["support"], -len(r["tokens"]), r["tokens"], r["verdict"]) for r in rules if set(r["tokens"]) <= set(own)]
    best = urls.best_rule(sorted(own), urls.matcher(rules))
    assert (best is None) == (not fit)
    if best:
        assert (-best["confidence"], -best["support"], -len(best["tokens"]), best["tokens"], best["verdict"]) == min(fit)


def test_labels_decide_where_no_rule_does(spark):
    labels = spark.createDataFrame([(f"http://bad{i % 2}.org/casino/{i}", "block") for i in range(30)]
                                   + [(f"http://good{i % 3}.org/news/{i}", "allow") for i in range(30)] + [(None, "allow"), ("x", None)], "url string, label string")
    pages = spark.createDataFrame([(1, "http://new.org/casino/7"), (2, "http://new.org/news/7"), (3, "http://other.io/z")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, [], labels=labels, min_support=0.05).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_no_token_and_no_rule_is_left_out(spark):
    """Bodies of over ten tokens count in full: 14 tokens tell labels apart, the last only with all its companions."""
    data = [([f"a{i:02}" for i in range(14) if i != gap], "allow") for gap in range(14)] * 2
    data += [([f"a{i:02}" for i in range(14)], "block")] * 9 + [(["z", "y"], "allow"), (["z"], "block")] * 3
    df = spark.createDataFrame([(sorted(t), x) for t, x in data], "tokens array<string>, label string")
    got = {(tuple(r["tokens"]), r["verdict"]): r for r in urls.mined_rules(df, 0.01, 0.8)}
    every = tuple(f"a{i:02}" for i in range(14))
    assert got[every, "block"]["confidence"] == 1.0 and got[every, "block"]["support"] == 9
    for (body, label), r in got.items():
        held = [x for t, x in data if set(body) <= set(t)]
        assert (r["confidence"], r["support"]) == (pytest.approx(held.count(label) / len(held)), held.count(label))
    assert got[("y",), "allow"]["confidence"] == 1.0 and (("y", "z"), "allow") not in got


def test_more_than_5000_rules_and_long_urls_judge(spark):
    """Rules of lower confidence act beside thousands of sure ones; a long url that stands twice does not blow up."""
    labels = [(f"http://h{i}.org/q{i}", "block") for i in range(2600) for _ in range(2)]
    labels += [("http://x.net/mostly/" + ("a" if i % 10 else "b"), "allow" if i % 10 else "block") for i in range(30)]
    labels += [("http://y.net/" + "/".join(f"part{j}" for j in range(60)), "block")] * 2
    df = spark.createDataFrame(labels, "url string, label string")
    pages = spark.createDataFrame([(1, "http://new.io/mostly"), (2, "http://h2599.io/"), (3, "http://new.io/part59"), (4, "http://new.io/")],
                                  "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages, [], labels=df, min_support=0.0, default="none").collect()}
    assert (got[1].verdict, got[1].mined, got[1].confidence) == ("allow", "p:mostly", pytest.approx(0.9))
    assert (got[2].verdict, got[3].verdict, got[4].verdict) == ("block", "block", "none")


SETS = st.lists(st.tuples(st.lists(st.sampled_from("abcdefg"), unique=True).map(sorted), st.sampled_from(["allow", "block", "ask"])), min_size=1, max_size=25)


@settings(max_examples=200, deadline=None)
@given(SETS)
def test_growing_keeps_every_set_that_can_be_a_rule(rows):
    import numpy as np
    tokens = np.array([ord(t) for own, _ in rows for t in own], np.int64)
    bounds = np.cumsum([0] + [len(own) for own, _ in rows])
    names = sorted({x for _, x in rows})
    got = {b: c.tolist() for b, c, _ in urls._grown(tokens, bounds, np.array([names.index(x) for _, x in rows]), np.ones(len(rows), np.int64), 2)}
    count = lambda body: [sum(set(body) <= set(own) and x == name for own, x in rows) for name in names]
    for size in range(8):
        for body in combinations("abcdefg", size):
            c, under = count(body), [count(body[:i] + body[i + 1:]) for i in range(size)]
            key = tuple(map(ord, body))
            if key in got:
                assert got[key] == c
            elif max(c) >= 2:  # each label is as sure by a subset
                assert all(any(u[i] * sum(c) >= c[i] * sum(u) for u in under) for i in range(len(names)) if c[i] >= 2)
