"""The licence classifier on licences it never saw, full bodies, and its words that a family needs."""

import numpy as np

from lapwing.llm import license_scan as ls

UNSEEN = ("This file is under the Sleepycat License.", "distributed under the CeCILL licence", "Ruby License applies to this gem", "The licensing office moved", "subject to the terms of the Foo Bar agreement")
BODIES = {
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the notice appears in all copies.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "MIT": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-SA": "Licensed under CC BY-SA 3.0",
}


def test_unseen_licences_and_bodies(spark):
    df = spark.createDataFrame([*enumerate(UNSEEN), *((100 + k, t) for k, t in enumerate(BODIES.values()))], "doc_id long, text string")
    got = {r["doc_id"]: list(r["families"]) for r in ls.scan_licenses(df).collect()}
    assert all(got[k] == [] for k in range(len(UNSEEN))), got
    assert [got[100 + k] for k in range(len(BODIES))] == [[f] for f in BODIES]


def test_no_family_without_one_of_its_words():
    model, rng = ls.Model([]), np.random.default_rng(3)
    vocab, anchors = sorted(model.vocab), set(model.anchors)
    for _ in range(2000):
        picked = [vocab[k] for k in rng.choice(len(vocab), rng.integers(0, 6), replace=False)]
        x = np.zeros(len(vocab) + 1)
        x[[model.vocab[g] for g in picked]] = 1
        x[-1] = 1
        if (x @ model.weights).argmax():
            assert anchors & {w for g in picked for w in g.split()}


def test_the_pattern_matches_its_words_only():
    import re

    words = ["gpl", "gnu", "agpl", "a", "license", "licensed", "c++"]
    pattern = re.compile("^" + ls._one_of(sorted(words)) + "$")
    assert all(pattern.match(w) for w in words)
    assert not any(pattern.match(w) for w in ("", "gp", "gn", "licens", "licensee", "ag", "ccc"))
