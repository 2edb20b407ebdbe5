"""Collocations against brute force: overlaps, pieces, nulls, long pieces cut with overlap, sketches that collide."""

import re
from collections import Counter

import numpy as np
import pytest

from lapwing.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, phrase string, f int"


def pieces(text):
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    cand = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    inside = Counter()
    for (lang, *w), v in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = (lang, *w[i : i + m])
                inside[key] = max(inside[key], v)
    out = []
    for (lang, *w), a in cand.items():
        if inside[(lang, *w)] >= a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, k + 1, *x[1:]) for k, x in enumerate(mine[:top])]
    return sorted(ranked)


def _texts(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "city", "a", "b", "the", "é", "日本", "x y", "don't", "A", "\x1c", "of"]
    rows = []
    for k in range(n):
        text = "".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", "\t", ", ", ".\n", " "])) for _ in range(int(rng.integers(0, 60))))
        rows.append((None if k % 17 == 0 else "" if k % 19 == 0 else text + "a a a a new york city", [None, "en", "de"][k % 3]))
    return rows


@pytest.mark.parametrize(("bits", "shard"), [(20, 1 << 22), (14, 1 << 22), (20, 64)])
def test_equals_brute_force(spark, monkeypatch, bits, shard):
    rows = _texts(1)
    monkeypatch.setattr(c, "SHARD_BYTES", shard)
    docs = spark.createDataFrame([(k, t, g, "p", 1) for k, (t, g) in enumerate(rows)], SCHEMA).repartition(4)
    got = c.collocations(docs, least=12, top=40, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 12, 40)


def test_parts_lose_and_double_nothing():
    """A long piece is cut between words, with the words after the cut that its phrases need."""
    text = " ".join(str(k % 7) for k in range(400)) + "\n" + "z " * 90 + "\n\n" + "q" * 300 + " end"
    want = c.occurrences(c.Shard(text, 1), ["1 2", "6 0 1 2 3", "z z z", "q" * 300 + " end", "3"])
    for size in (5, 17, 64, 1000):
        shards = [c.Shard(t, 1, own) for t, own in c.parts(text, size)]
        got = Counter()
        for s in shards:
            got.update(c.occurrences(s, ["1 2", "6 0 1 2 3", "z z z", "q" * 300 + " end", "3"]))
        assert got == want and sum(int((~s.end[: s.owned]).sum()) for s in shards) == 492


def test_overlaps_count():
    s = c.Shard("a a a a\na a", 1)
    assert c.occurrences(s, ["a a", "a a a", "a a a a"]) == {0: 4, 1: 2, 2: 1}
    assert s.starts(2).tolist() == [0, 1, 2, 5] and sorted(s.phrases(s.starts(3), 3)) == ["a a a"]


def test_copies_and_nothing(spark):
    docs = spark.createDataFrame([(k, "Big Data, big data rocks", "en", "p", 1) for k in range(300)], SCHEMA)
    got = sorted(map(tuple, c.collocations(docs).collect()))
    assert got == brute([("Big Data, big data rocks", "en")] * 300, 100)
    assert c.collocations(docs.where("doc_id < 0")).collect() == []
    assert c.collocations(docs.where("doc_id < 20")).collect() == []


def test_scores_beyond_64_bits(spark):
    """1000 a n of a count like 3e9 doesn't fit a long; the decimals do."""
    got = spark.sql("SELECT (cast(1000 * 3000000000L as decimal(19,0)) * cast(4000000000000L as decimal(19,0))) div (cast(3000000000L as decimal(19,0)) * cast(3000000000L as decimal(19,0))) AS s").first()["s"]
    assert got == 1000 * 3_000_000_000 * 4_000_000_000_000 // (3_000_000_000 * 3_000_000_000)
