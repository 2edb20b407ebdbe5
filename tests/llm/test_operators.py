"""Operators of the training-data subpackage against brute force, round trips and held-out labels."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.llm import bpe, chat_format, components, decontaminate, exact_dedup, license_scan, near_dedup, quality, registry, token_count, toxicity, url_filter

D = "/root/testdata/sf0.001"
ODD = [(1, "  Hi\tthere\n\n"), (2, None), (3, ""), (4, "x" * 5000), (5, "<|endoftext|> a<|endoftext|>"), (6, "中文 テスト 😀 é"), (7, "hi  hi   hi"), (7, "hi  hi   hi"), (None, "null id"), (8, "\u00a0 \r\n 12'34 don't"), (9, "word " * 9000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "z", "c") for i, t in ODD], "doc_id long, text string, ids int, decoded string, id string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, D)
    cur = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    key = sorted(names)
    assert sorted(repr(tuple(r[c] for c in key)) for r in df.collect()) == sorted(repr(tuple(r[names.index(c)] for c in key)) for r in cur.fetchall())


def test_bpe_is_the_librarys(spark, odd, library):
    for r in bpe.decode(bpe.encode(odd)).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(odd.limit(0)).count() == 0 and bpe.encode(odd).count() == len(ODD)


def test_bpe_fuzzed(library):
    rng = np.random.default_rng(5)
    parts = ["a", "the", " ", "  ", "\n", "'s", "é", "中", "7", "<|endoftext|>", "<|end", "!!", "aaaa", "\x1c", "\u3000", "\r\n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 15))) for _ in range(4000)]
    coder = bpe.Encoder(bpe.vocabulary_path("byte_bpe_50k.json"))
    assert [np.frombuffer(b, np.int32).tolist() for b in coder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, odd, library):
    for huge in (32_768, 40):
        for r in token_count.count_tokens(odd, huge=huge).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
            assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
            assert r["n_bytes"] == len((r["text"] or "").encode())


def test_overlaps_widen_until_they_align(library):
    _, begins = token_count.library(bpe.vocabulary_path("byte_bpe_50k.json"))
    for text in ("word " * 500, "x" * 700 + " y" * 300, "\n\n".join(["a b"] * 200), "no" * 900, " " * 600, "a<|endoftext|> b " * 60):
        assert token_count.count_huge(text, begins, 64, 4) == len(library.encode(text, add_special_tokens=False).ids), text[:20]


def test_chat_comes_back(spark):
    texts = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\/s>", "", None, "<<SYS>>x\n<</SYS>>", "<", "<<s>>", "plain"]
    roles = ["user", "assistant", "system", None, "to<s>ol\n\\n", "assistant", "user", "user"]
    rows = [(k % 2, 7 if k > 5 else k, r, t, 0) for k, (r, t) in enumerate(zip(roles, texts, strict=True))]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, formatted int")
    got = {r["conv_id"]: r["turns"] for r in chat_format.format_chat(df).select("conv_id", chat_format.parse_chat(F.col("formatted")).alias("turns")).collect()}
    for c in (0, 1):
        want = [(r or "", t or "") for _, r, t in sorted((turn, r or "", t or "") for cc, turn, r, t, _ in rows if cc == c)]
        assert [(t["role"], t["text"]) for t in got[c]] == want
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_cuckoo_index():
    index = exact_dedup.CuckooIndex(4)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k, key in enumerate(keys):
        assert index.find(key) is None
        index.insert(key, k)
    assert index.resizes and all(index.find(key)[1] == k for k, key in enumerate(keys))
    assert all(index.delete(key) for key in keys[::2]) and not index.delete(keys[0])
    assert [index.find(key) is not None for key in keys] == [k % 2 == 1 for k in range(3000)]


def test_exact_dedup_odd_rows(spark):
    df = spark.createDataFrame([(1, "A b", 0), (5, "a B", 0), (2, None, 0), (3, "", 0), (None, "a b", 0), (None, "q", 0), (9, "É", 0), (8, "é", 0), (4, "t", 0), (4, "t", 0)], "doc_id long, text string, keep_id int")
    got = sorted(repr((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"])) for r in exact_dedup.exact_dedup(df).collect())
    assert got == sorted(map(repr, [("1", 5, 3, False), ("2", 3, 2, False), ("3", 3, 2, True), ("4", 4, 2, True), ("4", 4, 2, True), ("5", 5, 3, True), ("8", 8, 1, True), ("9", 9, 1, True), ("None", None, 1, True), ("None", 5, 3, False)]))
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def brute_components(texts: dict[int, str], width: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    comp = {i: i for i in texts}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def test_near_dedup_of_a_long_list_of_variants(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(90)]
    texts = {}
    for i in range(140):  # edits of one text, some beyond the threshold, in lists longer than SMALL
        words = list(base)
        for k in rng.choice(90, rng.integers(0, 14), replace=False):
            words[k] = f"e{rng.integers(0, 60)}"
        texts[i] = " ".join(words)
    texts |= {200: "", 201: "one", 202: "ONE", 203: "a b c d e f", 204: "a b c d e f g"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(None, "one", 1), (205, None, 1)], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, 2, "4/5").collect() if r["doc_id"] is not None}
    assert got == brute_components(texts, 2) | {205: 205}
    assert near_dedup.near_dedup(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, components.components(links).collect()))
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_near_dedup_matches_five_word_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs).collect()}
    assert got == brute_components(texts, 5)


def test_levenshtein_automaton():
    entries = [toxicity.Entry(t, s, 5.0, 4.0) for t, s in (("stupid", False), ("lowei", True), ("scum", False))]
    a = toxicity.Automaton(entries)
    assert a.match("stupid") == {0: 0} and a.match("stupid") == {0: 0} and a.match("stpid") == {0: 1} and a.match("stuppid") == {0: 1} and a.match("stup1d") == {0: 1}
    assert a.match("stp1d") == {} and a.match("loweierungen") == {1: 0} and a.match("loveierungen") == {1: 1} and a.match("scam") == {} and a.match("scum") == {2: 0}


def test_quotation_counts_less_than_abuse():
    lexicon = toxicity.Lexicon([toxicity.Entry("moron", False, 6.0, 5.0)])
    s = toxicity.Scorer(lexicon)
    said, meant = s.features('the witness said "moron" was the word he heard')[0], s.features("you are such a moron and all know it well")[0]
    assert said[0] < 0.5 * meant[0] and s.features("")[0][0] == 0 and s.features("m0ron here")[1] == ["moron"]


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = registry.op7_toxicity(spark, d).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang = 'en'").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.93
    lexicon = toxicity.fit(docs, labels)
    assert toxicity.score(docs.limit(0), lexicon).count() == 0
    one = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score(one, lexicon).collect())
    empty = toxicity.fit(docs, labels.where("toxic = 0"))
    assert not empty.entries and toxicity.score(docs, empty).count() == docs.count()


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = registry.op3_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in got) / len(got) > 0.95
    assert quality.classify_quality(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2
    assert quality.classify_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_url_parts_and_terms(spark):
    df = spark.createDataFrame([(1, "HTTP://Shop.Example.NET/en/a?x#y"), (2, None), (3, "no scheme"), (4, "https://net"), (5, "https://a.org/fr/xcasinox"), (6, "https://a.b/cheap-win"), (7, "https://a.b/cheap/cheap"), (8, "x://org/fr/casino")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df).collect()}
    assert got[1] == ("shop.example.net", "/en/a", "example.net/en/", "allow") and got[2] == ("", "", None, "allow") == got[3] and got[4] == ("net", "", None, "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][3] == "block" and got[7][3] == "allow" and got[8][2:] == ("org/fr/", "allow")


def test_license_lines(spark):
    texts = {1: "A text.\nReleased under the MIT License.", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "He lost his fishing license in public", 4: None, 5: "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in license_scan.scan_licenses(df).collect()}
    assert got == {1: ["MIT"], 2: ["GPL"], 3: [], 4: [], 5: ["Apache-2.0", "CC-BY-NC"]}
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_leaks_match_brute_force(spark):
    docs, bench = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    near = list(items[0].upper().split())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(9001, "Intro here. " + " ".join(near) + " and more"), (9002, " ".join(items[1].split()[:8])), (None, "x " + items[2]), (9003, None), (9004, "")]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_ids", F.lit(1))
    bench = bench.union(spark.createDataFrame([(7001, "only three words"), (7002, None), (7003, "")], "item_id long, text string"))
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    cut = {i: words(t) for i, t in [*items.items(), (7001, "only three words")]}
    want = set()
    for d, t in rows:
        w = words(t)
        for i, v in cut.items():
            k = min(5, len(v))
            mine = {tuple(v[x : x + k]) for x in range(len(v) - k + 1)}
            for s in range(max(1, len(w) - len(v) + 1)):
                own = {tuple(w[s : s + len(v)][x : x + k]) for x in range(len(w[s : s + len(v)]) - k + 1)}
                if own and 100 * len(own & mine) >= 80 * len(own | mine):
                    want.add((d, i))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(more, bench).collect()}
    assert got == want and (9001, 0) in got and (None, 2) in got
    assert decontaminate.decontaminate(more.limit(0), bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = [docs]
    for _, stage in p.STAGES:
        kept.append(stage(spark, kept[-1], D).cache())
    names = [set(r[0] for r in k.select("doc_id").collect()) for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    score = {r["doc_id"]: r["score"] for r in toxicity.score(kept[0], toxicity.fit(kept[0], spark.read.parquet(f"{D}/labels.parquet"))).collect()}
    assert names[1] == {i for i in names[0] if score[i] < 0.5}
    texts = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    best: dict = {}
    for i, t in texts.items():
        best[t.lower()] = max(i, best.get(t.lower(), -1))
    assert names[2] == set(best.values())
    comp = brute_components({i: texts[i] for i in names[2]}, 5)
    assert names[3] == {i for i in names[2] if comp[i] == i}
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(kept[3], spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    assert names[4] == names[3] - leaks and names[5] == names[4]
    assert {r["doc_id"] for r in p.run(spark, D).select("doc_id").collect()} == names[5]
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in kept[5].collect())
