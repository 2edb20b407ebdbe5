"""Long lists: regions of near copies against brute force over all pairs."""

import numpy as np

from lapwing.llm import near_dedup


def brute(sets):
    """Component (smallest index) of each set, by all pairs at 0.8 or more."""
    words = {w: k for k, w in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(words)), np.float32)
    for k, s in enumerate(sets):
        held[k, [words[w] for w in s]] = 1
    both, size = (held @ held.T).astype(int), held.sum(1).astype(int)
    link = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    low = np.arange(len(sets))
    while True:
        after = np.where(link, low[None, :], len(sets)).min(1)
        if (after == low).all():
            return low.tolist(), link
        low = after


def test_two_thousand_variants_lose_no_link(spark):
    rng = np.random.default_rng(11)
    base, passage = [f"w{k}" for k in range(150)], [f"p{k}" for k in range(40)]
    texts = []
    for i in range(2000):
        words = list(base)
        for k in rng.choice(150, rng.integers(0, 9) if i >= 260 else rng.integers(9, 13), replace=False):
            words[k] = f"e{rng.integers(0, 4000)}"
        texts.append(words)
    for i in range(60):  # strays that copy one another's edits
        words = list(texts[i])
        words[int(rng.integers(0, 150))] = "z"
        texts.append(words)
    for i in range(150):  # different documents that share a passage
        texts.append([f"d{i}x{k}" for k in range(30)] + passage + [f"d{i // 2}y{k}" for k in range(8)])
    sets = [set(zip(w, w[1:], strict=False)) for w in texts]
    want, link = brute(sets)
    assert 100 < sum(c == k for k, c in enumerate(want)) and link.sum() > 10**6
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, 2, "4/5").collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_blocks_of_a_region_agree(spark, monkeypatch):
    """Many small blocks give what one gives, also for two dense clusters that a chain joins."""
    rng = np.random.default_rng(3)
    texts = []
    for tag in "ab":
        for _ in range(90):
            words = [f"{tag}{k}" if k < 25 else f"s{k}" for k in range(100)]
            for k in rng.choice(100, 3, replace=False):
                words[k] = f"e{rng.integers(0, 900)}"
            texts.append(words)
    texts += [[f"{'b' if k < x else 'a'}{k}" if k < 25 else f"s{k}" for k in range(100)] for x in range(0, 26, 4)]
    want, _ = brute([set(zip(w, w[1:], strict=False)) for w in texts])
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "ROWS", 20)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, 2, "4/5").collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_common_values_over_many_columns():
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 9000, rng.integers(0, 900))) for _ in range(n)] for n in (7, 5))
    want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert near_dedup._common(left, right).tolist() == want
    assert near_dedup._common([], right).shape == (0, 5) and near_dedup._common([np.empty(0, np.int64)], right).tolist() == [[0] * 5]
