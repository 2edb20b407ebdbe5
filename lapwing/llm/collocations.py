"""Phrase collocation mining: sketches bound the counts, automata count what the bounds let through.

Texts are read in shards of a few megabytes. The first pass adds the words and word pairs of each shard to a
sketch, a table of cells by hash whose sums are upper bounds; the second does so for longer phrases whose
pairs may all be frequent, and the words of such pairs. In the third, a shard's phrases whose bounds reach `least` are compiled into an
automaton with delimiters about each phrase, the shard is scanned with it, overlapping matches included, and
the shards' counts are added up and held against the threshold. No frequent phrase is lost, because a bound
never is below the count, and what shards count is exact. A shard's automaton holds its own phrases
only, so memory depends on the shard, not on the corpus; the bitmaps of sketch cells that reach the threshold
have a fixed size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import LOWER, UPPER, Scratch, stored

LEAST, LONGEST, TOP, UNKNOWN = 100, 5, 2000, "und"
SHARD_BYTES = 4 << 20
BLOCK = 1 << 14  # cells of a block of the sketch
TASK_CELLS = 1 << 20  # cells that a task adds up
HELD_PHRASES = 500_000  # phrases whose counts a task holds before it hands them on
SKETCH_BITS = 26  # log2 of the cells; a bitmap of them is 8 MB
#: A-Z lower-cased, ends of pieces as a line feed, white space between words as a blank; bytes of UTF-8 sequences stay.
_NORMAL = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\x0d\x09", LOWER.encode() + b"\n" * 9 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shard:
    """Part of the texts of a language: its words as numbers, hashes of words, and the string that is scanned.

    `owned` is the number of words at which counted phrases may begin; words after it belong to the next part
    of the same piece.
    """

    def __init__(self, text: str, seed: int, owned: str | None = None) -> None:
        words = pc.split_pattern(pa.array([text.replace("\n", " \n ")], pa.large_string()), " ").values
        words = words.filter(pc.not_equal(words, "")).dictionary_encode()
        self.ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = words.dictionary.to_pylist()
        self.owned = len(self.ids) if owned is None else sum(1 for w in owned.replace("\n", " \n ").split(" ") if w)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        is_end = np.fromiter((w == "\n" for w in self.words), bool, len(self.words))
        self.end = is_end[self.ids] if len(self.ids) else np.zeros(0, bool)

    def starts(self, width: int, among: np.ndarray | None = None) -> np.ndarray:
        """Places where a phrase of `width` words begins within a piece, of those in `among` (places of phrases a word shorter)."""
        n = len(self.ids)
        if among is None:
            among = self.starts(width - 1) if width > 1 else np.arange(n)
        at = among[among + width <= n]
        return at[~self.end[at + width - 1]]

    def cells(self, at: np.ndarray, width: int, bits: int) -> np.ndarray:
        """Sketch cells of the phrases that begin at `at`."""
        h = np.full(len(at), width, np.uint64)
        for k in range(width):
            h = (h ^ self.hashes[self.ids[at + k]]) * _MIX
            h ^= h >> np.uint64(29)
        return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)

    def phrases(self, at: np.ndarray, width: int) -> list[str]:
        """The distinct phrases that begin at `at`."""
        code = self.ids[at]
        for k in range(1, width):  # numbers of distinct phrases, a word longer each time
            _, code = np.unique(code, return_inverse=True)
            code = code * len(self.words) + self.ids[at + k]
        _, first = np.unique(code, return_index=True)
        return [" ".join(self.words[i] for i in self.ids[p : p + width]) for p in at[first]]

    def scanned(self) -> str:
        return " " + " ".join(self.words[i] for i in self.ids) + " "


def parts(text: str, size: int = SHARD_BYTES) -> Iterator[tuple[str, str | None]]:
    """Cuts a text between pieces into parts of about `size` characters; a longer piece between words, as (with LONGEST - 1 more words, part)."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind("\n", at, at + size)
        if cut > at:
            yield text[at:cut], None
        else:
            cut = text.rfind(" ", at, at + size)
            cut = cut if cut > at else next((k for k in (text.find(" ", at + size), text.find("\n", at + size)) if k >= 0), len(text))
            more, words = cut, 0
            while more < len(text) and text[more] != "\n" and words < LONGEST:  # the blank that ends the last of them
                more += 1
                words += more < len(text) and text[more] == " " and text[more - 1] != " "
            yield text[at:more], text[at:cut]
        at = cut
    yield text[at:], None


def shards(batch: pa.RecordBatch) -> Iterator[tuple[str, Shard]]:
    """(lang, shard) of rows (lang, text binary), each language's texts together."""
    groups: dict[str, list[str]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
        groups.setdefault(lang, []).append((text.as_py() or b"").translate(_NORMAL).decode("utf-8", "replace"))
    for lang, texts in groups.items():
        seed, held, size = xxhash.xxh32_intdigest(lang), [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= SHARD_BYTES:
                yield from ((lang, Shard(t, seed, own)) for t, own in parts("\n".join(held)))
                held, size = [], 0
        if held:
            yield from ((lang, Shard(t, seed, own)) for t, own in parts("\n".join(held)))


def reaches(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def frequent_starts(shard: Shard, low: np.ndarray, high: np.ndarray | None, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(width, places) of phrases whose bounds may reach the threshold, those of all their parts included.

    `low` is the bitmap for words and pairs; without `high`, the one for longer phrases, the pairs alone decide.
    """
    one = shard.starts(1)
    one = one[reaches(low, shard.cells(one, 1, bits))]
    yield 1, one
    hot = np.zeros(len(shard.ids) + 1, bool)
    hot[one] = True
    pair = one[hot[np.minimum(one + 1, len(shard.ids))]]
    pair = shard.starts(2, pair)
    at = pair[reaches(low, shard.cells(pair, 2, bits))]
    yield 2, at
    for width in range(3, LONGEST + 1):
        shorter = np.zeros(len(shard.ids) + 1, bool)
        shorter[at] = True
        at = shard.starts(width, at[shorter[np.minimum(at + 1, len(shard.ids))]])
        if high is not None:
            at = at[reaches(high, shard.cells(at, width, bits))]
        yield width, at


_ENTRIES = pa.schema([("block", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])


def _entries(cells: np.ndarray) -> pa.RecordBatch:
    """Counts of cells by block: places in the block as uint16, counts as uint32."""
    found, n = np.unique(cells, return_counts=True)
    block, first = np.unique(found // BLOCK, return_index=True)
    at, n, ends = (found % BLOCK).astype(np.uint16), n.astype(np.uint32), [*first[1:], len(found)]
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), cut(at), cut(n)], schema=_ENTRIES)


def sketch(texts: DataFrame, bits: int, least: int, low: np.ndarray | None = None) -> np.ndarray:
    """The bitmap of sketch cells whose counts reach `least`: of words and pairs, or with `low` of longer phrases whose pairs may be frequent and of the words in such pairs.

    Counts are added up by block in tasks that hold a few blocks each; what comes to the driver is 2^bits / 8 bytes at most.
    """
    context = texts.sparkSession.sparkContext
    held = None if low is None else context.broadcast(low)

    def longer(s: Shard, low: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for w, at in frequent_starts(s, low, None, bits):
            if w == 2:
                paired = np.zeros(len(s.ids), bool)
                paired[at] = paired[at + 1] = True
                yield 1, np.flatnonzero(paired)
            elif w > 2:
                yield w, at

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s in shards(batch):
                if held is None:
                    widths = ((w, s.starts(w)) for w in (1, 2))
                else:
                    widths = longer(s, held.value)
                cells = [s.cells(at[at < s.owned], w, bits) for w, at in widths]
                if sum(map(len, cells)):
                    yield _entries(np.concatenate(cells))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(batch.column("block").to_pylist(), batch.column("at"), batch.column("n"), strict=True):
                cells = sums.setdefault(block, np.zeros(BLOCK, np.int64))
                cells[np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.uint32)
        rows = [(b, np.packbits(c >= least).tobytes()) for b, c in sums.items() if (c >= least).any()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "bits"])

    added = texts.mapInArrow(add, "block int, at binary, n binary")
    blocks = added.repartition(max(1, (1 << bits) // TASK_CELLS), "block").mapInArrow(total, "block int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in blocks.collect():
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    if held is not None:
        held.destroy()
    return out


def occurrences(shard: Shard, patterns: list[str]) -> Counter:
    """How often each phrase occurs in the shard, overlaps included, by an automaton of the phrases with a blank on either side."""
    if not patterns:
        return Counter()
    automaton = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        automaton.add_word(f" {p} ", k)
    automaton.make_automaton()
    found = automaton.iter(shard.scanned())
    if shard.owned < len(shard.ids):  # matches that begin in the next part are counted there
        limit = sum(len(shard.words[i]) + 1 for i in shard.ids[: shard.owned])
        found = ((end, k) for end, k in found if end - len(patterns[k]) - 1 < limit)
    return Counter(map(itemgetter(1), found))


def task_counts(docs: DataFrame, least: int = LEAST, bits: int = SKETCH_BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, width, phrase, f) as each task has counted them, to be added up: of all phrases that may occur `least` times, of the words in them, and with width 0 of all words.

    A frequent phrase is in nearly every part of the texts, so each task hands on nearly all of them. As many tasks as
    the cluster has cores count, whatever the number of parts: what they hand on grows with the phrases, not with
    phrases times parts. They stream, and hold HELD_PHRASES at most.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    low = sketch(texts, bits, least)
    high = sketch(texts, bits, least, low)
    context = docs.sparkSession.sparkContext
    maps = context.broadcast((low, high))
    names = ["lang", "width", "phrase", "f"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for lang, s in shards(batch):
                patterns: list[str] = []
                for width, at in frequent_starts(s, *maps.value, bits):
                    own = at[at < s.owned]
                    if width == 1:  # the words of pairs that may be frequent
                        own = own[reaches(maps.value[1], s.cells(own, 1, bits))]
                        ids, n = np.unique(s.ids[own], return_counts=True)
                        sums.setdefault((lang, 1), Counter()).update({s.words[i]: k for i, k in zip(ids, n.tolist(), strict=True)})
                    else:
                        patterns += s.phrases(own, width)
                for k, n in occurrences(s, patterns).items():
                    sums.setdefault((lang, patterns[k].count(" ") + 1), Counter())[patterns[k]] += n
                sums.setdefault((lang, 0), Counter())[""] += int((~s.end[: s.owned]).sum())
            if sum(map(len, sums.values())) > HELD_PHRASES:
                yield from counted(sums)
                sums = {}
        yield from counted(sums)

    def counted(sums: dict[tuple[str, int], Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, width), c in sums.items():
            columns = ([lang] * len(c), pa.string()), ([width] * len(c), pa.int32()), (list(c), pa.string()), (list(c.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], names)

    return texts.coalesce(max(1, context.defaultParallelism)).mapInArrow(count, "lang string, width int, phrase string, f long")


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int = SKETCH_BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, width, phrase, f): exact counts of all phrases of 2 to LONGEST words that occur `least` times in a language, of the words in them, and with width 0 of all its words.

    A null lang is `und`, a null text the empty one. Rows that repeat count again. No columns other than these two are read.
    """
    got = task_counts(docs, least, bits, text_col, lang_col)
    return got.groupBy("lang", "width", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("width") == 0))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = 100, bits: int = SKETCH_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to LONGEST words with a = f(phrase) >= `least`.

    A phrase is cut after its first k words into parts with counts l and r; the score is floor(1000 a n / (l r)) of the
    lowest-scoring cut (of equal ones the smallest k), in exact decimals. Phrases inside a longer one with
    100 f(longer) >= `cover` a are left out. Order: score and a descending, phrase by bytes. A language without frequent
    phrases has no rows, nor has an empty table.
    """
    with Scratch(docs.sparkSession) as keep:
        counted = keep(phrase_counts(docs, least, bits), "counts")
        f = counted.where("width > 0").select("lang", "phrase", "f")
        candidates = counted.where("width > 1").withColumn("w", F.split("phrase", " "))
        inner = "flatten(transform(sequence(2, width - 1), m -> transform(sequence(1, width - m + 1), i -> concat_ws(' ', slice(w, i, m)))))"
        inside = candidates.where("width > 2").select("lang", F.explode(F.expr(inner)).alias("phrase"), "f")
        longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        left = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f")))
        cuts = "transform(sequence(1, width - 1), k -> struct(k, concat_ws(' ', slice(w, 1, k)) as head, concat_ws(' ', slice(w, k + 1, width)) as rest))"
        cut = left.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.expr(cuts)))
        cut = cut.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
        cut = cut.join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        cut = cut.join(F.broadcast(counted.where("width = 0").select("lang", F.col("f").alias("n"))), "lang")
        big = lambda x: f"cast({x} as decimal(19, 0))"
        cut = cut.withColumn("score", F.expr(f"({big('1000 * a')} * {big('n')}) div ({big('l')} * {big('r')})"))
        best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
        ranked = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")).where(F.col("rank") <= top)
        return stored(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
e AS (SELECT lang, m AS width, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM w, range(1, {LONGEST + 1}) t(m), range(1, len(w) - m + 2) u(i)),
f AS (SELECT lang, width, phrase, count(*) AS f FROM e GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE width > 1),
i AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(f) AS longer FROM c, range(2, width) t(m), range(1, width - m + 2) u(j) GROUP BY ALL),
k AS (SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
    FROM c LEFT JOIN i ON c.lang = i.lang AND c.phrase = i.phrase, range(1, c.width) t(k) WHERE longer IS NULL OR 100 * longer < 100 * c.f),
s AS (SELECT k.lang, k.phrase, a, x.f AS l, y.f AS r, n, k, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM k JOIN f x ON x.lang = k.lang AND x.phrase = head JOIN f y ON y.lang = k.lang AND y.phrase = rest JOIN n ON n.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM b WHERE nth = 1)
SELECT * FROM o WHERE rank <= {TOP}"""
