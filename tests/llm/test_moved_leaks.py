"""Leaks whose parts were moved, against brute force over all windows."""

import numpy as np

from lapwing.llm import decontaminate


def grams(w, k=5):
    return {tuple(w[x : x + k]) for x in range(len(w) - k + 1)}


def test_moved_parts_are_found_where_no_shingle_keeps_its_place(spark):
    rng = np.random.default_rng(4)
    item, half = [f"i{k}" for k in range(100)], [f"h{k}" for k in range(60)]
    noise = lambda n: [f"n{x}" for x in rng.integers(0, 400, n)]
    docs = {
        1: noise(70) + item[20:] + item[:20] + noise(90),
        2: noise(230) + half[30:] + half[:30] + noise(15),
        3: item[20:] + item[:20],
        4: noise(40) + item[:50] + noise(60) + item[50:] + noise(10),
        5: noise(10) + item[:40] + ["x"] * 12 + item[40:88] + noise(40),
        6: noise(300),
        7: noise(5) + half[:27] + ["y"] * 4 + half[31:] + ["y"] * 6,
        8: item[10:99],
    }
    want = {}
    for d, w in docs.items():
        for i, v in ((100, item), (60, half)):
            top = max(((len(o & grams(v)) / len(o | grams(v))), -s) for s in range(max(1, len(w) - len(v) + 1)) if (o := grams(w[s : s + len(v)])))
            if top[0] >= 0.8:
                want[d, i] = (-top[1], round(top[0], 9))
    assert {(1, 100), (2, 60), (3, 100)} <= set(want)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(100, " ".join(item)), (60, " ".join(half))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 9)) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == want
