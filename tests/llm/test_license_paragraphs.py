"""Licence paragraphs: the scan against the model in Python, wrapped notices, other licences, rows."""

import textwrap

import numpy as np

from lapwing.llm import license_scan as ls

GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."


def test_the_scan_gives_what_the_model_gives(spark):
    lines = [f.format(t) for ts in ls.TEMPLATES.values() for t in ts for f in ls.FRAMES[:3]] + [*ls.OTHERS, *ls.OTHER_LICENCES]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: (r["family"], r["probability"]) for r in ls.scan_paragraphs(df, sample=0).collect()}
    model, wrong = ls.Model([]), 0
    for k, line in enumerate(lines):
        x = np.zeros(len(model.vocab) + 1)
        x[-1] = 1
        x[[model.vocab[g] for g in ls.grams(ls.tokens(line)) if g in model.vocab]] = 1
        q = ls._softmax((x @ model.weights * model.scale)[None])[0]
        family = model.classes[q.argmax()]
        if x[:-1].any() and family != ls.UNKNOWN:
            assert got[k][0] == family and abs(got[k][1] - q.max()) < 1e-4, line
        else:
            assert k not in got, line
        wrong += family != next((f for f, ts in ls.TEMPLATES.items() for t in ts if t in line), ls.UNKNOWN)
    assert wrong <= 0.05 * len(lines)


def test_wrapped_notices_other_licences_and_rows(spark):
    rows = [
        (1, "\n".join(textwrap.wrap("Some text. " + GPL, 60))), (2, "Eclipse Public License 2.0"), (3, "This file is licensed under the Eclipse Public License v2.0."),
        (4, "Intro.\nReleased under the MIT License.\nMore."), (4, "Intro.\nReleased under the MIT License.\nMore."), (None, "Intro.\nReleased under the MIT License.\nMore."), (None, "clean"), (5, None), (6, ""), (7, "x " * 20000 + "\n" + GPL),
    ]
    df = spark.createDataFrame([(i, t, "f", 3) for i, t in rows], "doc_id long, text string, families string, key int")
    got = sorted(repr((r["doc_id"], r["families"], r["n_license"])) for r in ls.scan_licenses(df).collect())
    want = {1: (["GPL"], 1), 4: (["MIT"], 1), 7: (["GPL"], 1)}
    assert got == sorted(repr((i, *(want.get(i, ([], 0)) if t != rows[5][1] else (["MIT"], 1)))) for i, t in rows)
    assert ls.scan_licenses(df.limit(0)).count() == 0
