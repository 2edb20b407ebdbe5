"""The misspelling automaton, expectation maximisation and held-out toxicity against plain versions."""

import random
import zlib

import numpy as np

from lapwing.llm import quality, registry, toxicity


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_the_automaton_is_levenshtein():
    rng = random.Random(3)
    word = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randint(lo, hi)))
    entries = [toxicity.Entry(t, rng.random() < 0.4, 5.0, 4.0) for t in sorted({word(3, 8) for _ in range(25)})]
    a = toxicity.Automaton(entries)
    for _ in range(3000):
        w = word(1, 10)
        want = {}
        for k, e in enumerate(entries):
            ends = range(1, len(w) + 1) if e.stem else [len(w)]
            near = min(distance(w[:n], e.text) for n in ends)
            if near == 0 or (near == 1 and len(e.text) >= toxicity.FUZZY):
                want[k] = near
        assert a.match(w) == want, w


def test_expectation_maximisation_over_patterns_is_that_over_rows():
    rng = np.random.default_rng(2)
    good = rng.random(3000) < 0.7
    votes = np.stack([np.where(rng.random(3000) < 0.6, np.where(rng.random(3000) < q, 1, -1) * np.where(good, 1, -1), 0) for q in (0.9, 0.8, 0.75, 0.95)], 1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, model, share = quality.expectation_maximisation(patterns, counts.astype(float))
    rows, model_rows, share_rows = quality.expectation_maximisation(votes, np.ones(3000))
    assert np.allclose(posterior[at.ravel()], rows, atol=1e-6) and np.allclose(model, model_rows, atol=1e-6) and abs(share - share_rows) < 1e-6
    assert ((rows > 0.5) == good).mean() > 0.9 and abs(share - good.mean()) < 0.05


def test_toxicity_in_all_languages(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = registry.op7_toxicity(spark, d).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("doc_id", "lang", "toxic", "predicted").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got) and len({r["lang"] for r in got}) == 4
    toxic = [r for r in got if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in got if r["toxic"] == 0) <= 0.01 * len(got)
    by_lang = {x: [r["predicted"] for r in toxic if r["lang"] == x] for x in {r["lang"] for r in toxic}}
    print({x: (sum(v), len(v)) for x, v in by_lang.items()})
    assert all(sum(v) >= 0.9 * len(v) for v in by_lang.values() if len(v) >= 20)
