"""Url rules of any number, weighted terms, and odd rows."""

import random

import pytest

from lapwing.llm import url_filter as u

URLS = [(1, "http://a.example.com/de/x"), (1, "http://a.example.com/de/x"), (None, "https://b.org/fr/"), (2, None), (3, ""), (4, "no scheme"), (5, "http://h7.net/p3/casino"), (6, "http://x.y.h8.net/p8/q?casino#z"), (7, "http:///p"), (8, "http://a.b/" + "x/" * 4000), (9, "http://.net/"), (10, "http://net./")]


def many(n):
    rng = random.Random(4)
    return [(rng.choice(("allow", "block")), f"{rng.choice(('', 'y.', 'x.y.'))}h{k % 40}.net", f"/p{k % 9}{rng.choice(('', '/', '/q'))}") for k in range(n)] + list(u.RULES)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def pages(spark):
    more = [(100 + k, f"http://{s}h{k % 45}.net/p{k % 10}/q{k}") for k in range(300) for s in ("", "y.", "x.y.", "z")]
    return spark.createDataFrame([(i, x, "h", "r") for i, x in URLS + more], "page_id long, url string, host string, rule string")


def test_a_join_gives_what_the_expression_gives(spark, pages, monkeypatch):
    rules = many(200)
    want = rows(u.url_filter(pages, rules=rules))
    monkeypatch.setattr(u, "MOST_RULES", 10)
    assert rows(u.url_filter(pages, rules=rules)) == want
    assert rows(u.url_filter(pages, rules=spark.createDataFrame(rules, "what string, rule_host string, rule_path string"))) == want
    assert len(want) == pages.count() and sum("rule=None" not in r for r in want) > 100


def test_the_longest_of_many_rules_by_brute_force(spark, pages):
    rules = {(h, p): w for w, h, p in sorted(many(2000))}
    assert len(rules) > u.MOST_RULES
    for r in u.url_filter(pages, rules=[(w, h, p) for (h, p), w in rules.items()]).collect():
        fit = sorted((-len(h + p), h + p, w) for (h, p), w in rules.items() if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p))
        assert r["rule"] == (fit[0][1] if fit else None)
        if fit:
            assert r["verdict"] == fit[0][2]


def test_weighted_terms_and_empty_tables(spark, pages):
    strict, soft = u.read_vocabulary(["# terms", "strict casino", "soft cheap 0.5", "soft win 2 # heavy", "", "soft deal"])
    assert strict == ["casino"] and soft == {"cheap": 0.5, "win": 2.0, "deal": 1.0}
    df = spark.createDataFrame([(1, "http://a.b/cheap/deal"), (2, "http://a.b/win"), (3, "http://a.b/cheap/deal/cheap"), (4, "http://a.b/CASINO"), (5, None)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in u.url_filter(df, strict, soft).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow"}
    assert u.url_filter(df.limit(0)).count() == 0 and u.url_filter(df, (), (), ()).where("verdict = 'block'").count() == 0
    with pytest.raises(ValueError):
        u.read_vocabulary(["hard x"])
