"""The Merkle manifest against a plain tree in Python, with nulls, ties, one row, no rows, clashing columns and a hot group."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lapwing.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def low(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(digests):
    """The root, and each leaf's sides from the lowest level up."""
    sides, place, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            sides[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes, place = [h(*nodes[a : a + 8]) for a in range(0, len(nodes), 8)], [p // 8 for p in place]
    return nodes[0], sides


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, h(*map(field, r))))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0], x[1]) if x[0][0] is not None else (False, 0, x[1]))
        trees[lang] = climb([d for _, d in groups[lang]])
    root, above = climb([trees[x][0] for x in langs])
    out = []
    for lang, up in zip(langs, above, strict=True):
        for (r, leaf), own in zip(groups[lang], trees[lang][1], strict=True):
            bent = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = h(*map(field, (*r[:4], low(r[4])))) if bent else leaf
            for before, after in own + up:
                folded = h(before, folded, after)
            out.append((r[0], leaf, trees[lang][0], root, h(*(b + a for b, a in own + up)), folded, folded == root))
    return sorted(map(repr, out))


CASES = {
    "one": [(7, "s", "en", 3, "Abc")],
    "two": [(2, None, None, None, None), (1, "s", "en", 0, "")],
    "odd": [(k if k % 5 else None, "web" if k % 2 else None, [None, "en", "", "de", "é", "zz"][k % 6], None if k % 7 == 0 else k, [None, "", "Text A", "x" * 30_000, "ÄÖ É"][k % 5]) for k in range(200)],
    "ties": [(k // 3, "s", "en", 1, "Same") for k in range(90)] + [(5, "s", "en", 1, "other")] * 40,
    "many languages": [(k, "s", f"l{k:03}", 1, f"T{k}") for k in range(130)],
    "lone run": [(k, "s", "en", 1, f"T{k}") for k in range(65)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_a_plain_tree(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", F.lit(1).alias("leaf"), F.lit("x").alias("g"), F.lit(2).alias("i"), F.lit(3).alias("n"))
    got = merkle.manifest_checks(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def test_empty_table(spark):
    assert merkle.manifest_checks(spark.createDataFrame([], SCHEMA)).collect() == []


def test_any_change_is_seen(spark):
    docs = spark.createDataFrame([(k, "s", "en" if k % 2 else "de", 1, f"t{k}") for k in range(40)], SCHEMA)
    got = merkle.merkle_manifest(docs, F.col("doc_id") == 7, F.lit("other"))
    folded = got.withColumn("ok", merkle.fold(F.col("tampered_leaf"), F.col("sides")) == F.col("root"))
    assert [r["doc_id"] for r in folded.where("NOT ok").collect()] == [7]
    assert folded.where(merkle.fold(F.col("leaf"), F.col("sides")) != F.col("root")).count() == 0
