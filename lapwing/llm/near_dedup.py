"""Near-dedup by bottom-k sketches of one hash function.

Equal shingle sets are one class from the start; a class has the sketch of its set, the K smallest
hashes. Inverted lists of retained values give the candidates: two sets that are similar enough
share at least NEED retained values (sets of up to 51 shingles and those similar to them are retained whole, so there it is
a count; above, missing it is a matter of about 1 in 10 million for a pair right at the threshold),
so one of the rarest |sketch| - NEED + 1 values of each suffices, and values that only one class
retains need no list. Candidates pass by their sizes, a bitmap of the sketch and the estimate from
the sketch of the union; the Jaccard similarity of the full sets decides.

Lists of up to SMALL classes are paired as they are. In longer ones copies are not expanded into
pairs: each long list has a hub, the class that stands in most long lists, and the lists of one hub
are one region. The larger the corpus, the more classes meet in long lists only because a value got common;
blocks of sketches tell which have a likely partner in their region, and the others leave it before any full set is
made. Every class that stays is held against its hub once, as the difference of their
full sets. Classes that link with the hub are one component, so only strays, those of other
components, can bring a new link: they meet the classes of their region in blocks of bounded rows
and values, where |a ^ b| = |d(a) ^ d(b)| for differences d from the hub gives the exact similarity
of all pairs at once, and only which components became one comes out of a block. So every link
between components of a region is found. Rows of sketches and of strays grow with a region's classes times its blocks.

Texts are never shuffled: a bitmap of the ids asked for goes to the tasks that read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import Scratch, stored
from lapwing.llm.components import components

#: Retained values, and those that a pair shares at least.
K, NEED = 64, 30
#: Classes of a list that is paired as it is, and common bits of bitmaps.
SMALL, BITS = 48, 22
#: About as many classes and values a block of a region has at most, columns of one product, and tasks that share a hub.
ROWS, VALUES, COLUMNS, SALTS = 2000, 400_000, 2048, 16
#: Bits of the bitmap of ids: so many for each id, at least and at most.
PER_ID, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
_WORDS = 300_000


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, width: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence if it is shorter."""
    words = text.lower().split()  # of bytes: A-Z, and the white space \x20 \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    with np.errstate(over="ignore"):
        s = np.zeros(len(w) - width + 1, np.uint64)
        for k in range(width):
            s = (s ^ w[k : len(w) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
    return np.unique(s)


def _bitmap(sketch: np.ndarray) -> list[int]:
    """256 bits, one for each retained value."""
    bits = np.zeros(256, bool)
    bits[(sketch >> np.uint64(8)) & np.uint64(255)] = True
    return np.packbits(bits).view(np.int64).tolist()


def _cell(col: str, bits: int) -> Column:
    """An id's place in a bitmap."""
    return F.pmod(F.xxhash64(col), F.lit(bits))


def _bitmap_of(ids: DataFrame, col: str) -> np.ndarray:
    """The bitmap of these ids, in words of 64 bits; a power of two, of 8 MB at most, so that ids may share a bit."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (PER_ID * ids.count()).bit_length()))
    cell = _cell(col, bits)
    words = ids.groupBy(F.floor(cell / 64).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))).alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out


def _sets(docs: DataFrame, width: int, sketches: bool, asked: np.ndarray | None = None) -> DataFrame:
    """(id, n, digest, sketch, bits) or (id, digest, hashes) of each row; with a bitmap only of rows whose id is in it."""
    rows = docs.select("id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    if asked is not None:
        rows = rows.withColumn("cell", _cell("id", 64 * len(asked)))
        shared = docs.sparkSession.sparkContext.broadcast(asked)

    def wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = batch.column("cell").to_numpy()
        return batch.filter(pa.array((shared.value[cell >> 6] >> (cell & 63)) & 1 == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            batch = batch if asked is None else wanted(batch)
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = [shingle_set(t.as_py() or b"", width, hashes) for t in part.column("text")]
                kept = [s[:K] if sketches else s for s in sets]
                values = np.concatenate(kept).view(np.int64) if kept else np.empty(0, np.int64)
                arrays = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), pa.array(values))
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                if sketches:
                    bitmaps = pa.array([_bitmap(s) for s in kept], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()), arrays, bitmaps], ["id", "n", "digest", "sketch", "bits"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests, pa.binary()), arrays], ["id", "digest", "hashes"])

    return rows.mapInArrow(run, f"id {kind}, n long, digest binary, sketch array<long>, bits array<long>" if sketches else f"id {kind}, digest binary, hashes array<long>")


def _full_sets(asked: DataFrame, classes: DataFrame, rows: DataFrame, width: int, store: Scratch) -> DataFrame:
    """(id, hashes): the full sets of the classes asked for. A class is found by a row's id and told from that id's other texts by its digest."""
    named = store(classes.select("id", "name", "digest").join(asked, "id", "left_semi"), "named")
    sets = _sets(rows, width, False, _bitmap_of(named, "name"))  # rows that only share a bit go by the join
    return sets.withColumnRenamed("id", "name").dropDuplicates(["name", "digest"]).join(named, ["name", "digest"]).select("id", "hashes")


def _similar(threshold: Fraction, both: Column, either: Column) -> Column:
    return both * F.lit(threshold.denominator) >= either * F.lit(threshold.numerator)


def _promising(threshold: Fraction, a: str, b: str) -> Column:
    """The union-sketch estimate: exact where the union fits into a sketch, else with room for chance."""
    x, y = F.col(f"sketch_{a}"), F.col(f"sketch_{b}")
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, K)
    both = F.size(F.array_intersect(F.array_intersect(x, y), union))
    sizes = _similar(threshold, F.least(f"n_{a}", f"n_{b}"), F.greatest(f"n_{a}", f"n_{b}"))
    full = (F.col(f"n_{a}") <= K) & (F.col(f"n_{b}") <= K) & (F.size(F.array_union(x, y)) <= K)
    return sizes & F.when(full, _similar(threshold, both, F.size(union))).otherwise(both >= NEED)


def _alike(threshold: Fraction, a: str, b: str) -> Column:
    """Cheap conditions on sizes and bitmaps (columns n_a, n_b, bits_a, bits_b); bitmaps only of large sets."""
    sizes = _similar(threshold, F.least(f"n_{a}", f"n_{b}"), F.greatest(f"n_{a}", f"n_{b}"))
    common = sum((F.bit_count(F.get(f"bits_{a}", F.lit(k)).bitwiseAND(F.get(f"bits_{b}", F.lit(k)))) for k in range(4)), F.lit(0))
    return sizes & ((F.least(f"n_{a}", f"n_{b}") <= int(K * threshold)) | (common >= BITS))


def _need(n: Column, threshold: Fraction) -> Column:
    return F.ceil(n * threshold.numerator / threshold.denominator).cast("int")


def _rarest(values: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, v): of the values (id, v) of each id the rarest `length` ones (of facts: id, size, length), without those of one id alone, which fill the length first."""
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(common, "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared")).join(facts, "id")  # one set at most
    length = F.greatest(F.col("length") - (F.col("size") - F.size("shared")), F.lit(0))
    return shared.select("id", F.explode(F.slice("shared", F.lit(1), length)).alias("s")).select("id", F.col("s.v").alias("v"))


def _postings(classes: DataFrame, threshold: Fraction, store: Scratch) -> DataFrame:
    """(v, id, n, bits) for the rarest retained values of each class that must meet a partner's, in lists of two or more; `list` is a list's length."""
    values = classes.select("id", F.explode("sketch").alias("v"))
    kept = F.size("sketch")
    need = F.when(F.col("n") <= int(K * threshold), _need(F.col("n"), threshold)).otherwise(F.lit(NEED))
    posts = store(_rarest(values, classes.select("id", kept.alias("size"), (kept - need + 1).alias("length"))), "posts")
    lists = posts.groupBy("v").agg(F.count("*").alias("list")).where("list > 1")
    return posts.join(lists, "v").join(classes.select("id", "n", "bits"), "id").select("v", "id", "n", "bits", "list")


def near_dedup(docs: DataFrame, width: int = 5, threshold: Fraction | str = "4/5", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, n_shingles long, component_id, kept boolean).

    Words are runs without \\x20 and \\x09-\\x0D, A-Z lower-cased; a set holds the distinct shingles of
    `width` words, told apart by 64-bit hashes. Rows whose sets have a Jaccard similarity of
    `threshold` or more are linked; component_id is the smallest id reachable. Rows without words (null or empty
    text) and rows with a null id are linked with nothing. Rows that repeat an id share its
    component if they share its text. Other columns are left out, so their names can't clash.
    """
    threshold = Fraction(threshold)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = stored(_sets(rows, width, True), "sketches")
    linkable = sketched.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    classes = linkable.groupBy("digest").agg(F.min("id").alias("name"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # its own: an id with two texts is in two classes
    found = class_components(classes, rows, width, threshold)
    low = found.join(classes.select("id", "name"), "id").groupBy("component").agg(F.min("name").alias("low"))
    of_class = classes.select("digest", "id", "name").join(found.join(low, "component").select("id", "low"), "id", "left").select("digest", F.coalesce("low", "name").alias("component_id"))
    linked = linkable.join(of_class, "digest").select("id", "n", "component_id")
    alone = sketched.where(F.col("id").isNull() | F.col("digest").isNull()).select("id", "n", F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def class_components(classes: DataFrame, rows: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """(id, component) of the classes that link with another."""
    with Scratch(classes.sparkSession) as store:
        postings = store(_postings(classes, threshold, store), "postings")
        side = lambda df, x: df.select("v", *(F.col(c).alias(f"{c}_{x}") for c in ("n", "bits")), F.col("id").alias(x))
        short = postings.where(F.col("list") <= SMALL)
        pairs = side(short, "a").join(side(short, "b"), "v").where((F.col("a") < F.col("b")) & _alike(threshold, "a", "b")).select("a", "b").distinct()
        pairs = store(_likely(pairs, classes, threshold), "pairs")
        members = store(_partnered(store(_regions(postings.where(F.col("list") > SMALL)), "regions"), classes, threshold), "members")
        asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.select("id")).distinct()
        sets = store(_full_sets(asked, classes, rows, width, store), "sets")
        links = _decided(pairs, sets, threshold)
        if members.isEmpty():
            return components(links)
        apart = store(_differences(members, sets, threshold), "differences")
        near = apart.where(F.col("linked") & (F.col("id") != F.col("region"))).select(F.col("region").alias("a"), F.col("id").alias("b"))
        links = store(links.union(near), "links")
        labels = components(links)
        merges = store(_across(apart, labels, threshold), "merges")
        return labels if merges.isEmpty() else components(links.union(merges))


def _regions(long: DataFrame) -> DataFrame:
    """(region, id): the classes of the long lists (v, id) of each hub. Of a list the class that stands in most long lists is the hub."""
    often = long.groupBy("id").agg(F.count("*").alias("lists"))
    hubs = long.join(often, "id").groupBy("v").agg(F.max(F.struct("lists", F.xxhash64("id"), "id")).alias("hub"))
    return long.join(hubs.select("v", F.col("hub.id").alias("region")), "v").select("region", "id").distinct()


def _partnered(members: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """(region, id): of the members those with a likely partner in their region by sketches, and the hubs of these regions; a region's blocks meet in pairs."""
    blocks = members.groupBy("region").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
    rows = members.join(blocks, "region").join(classes.select("id", "n", "sketch"), "id").withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("region", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "n", "sketch")
    num, den = threshold.numerator, threshold.denominator

    def likely(block: pd.DataFrame) -> pd.DataFrame:
        low, high = (block["own"].eq(block[c].iloc[0]) for c in ("low", "high"))
        a, b = block[low], block[high]
        n_a, n_b = a["n"].to_numpy(np.int64)[:, None], b["n"].to_numpy(np.int64)[None, :]
        shared = _common(list(a["sketch"]), list(b["sketch"]))
        whole = (n_a <= K) & (n_b <= K)  # sketches that hold their sets
        near = (np.minimum(n_a, n_b) * den >= np.maximum(n_a, n_b) * num) & np.where(whole, shared * den >= (n_a + n_b - shared) * num, shared >= NEED)
        near &= a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :]
        ids = np.union1d(a["id"][near.any(1)], b["id"][near.any(0)])
        return pd.DataFrame({"region": block["region"].iloc[0], "id": ids.astype(np.int64)})

    found = rows.groupBy("region", "low", "high").applyInPandas(likely, "region long, id long").select("region", F.explode(F.array("id", "region")).alias("id"))
    return found.distinct()


def _with_region(members: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows (region, id, ...) with what their region has, one row of `regions`; a region's rows are spread over SALTS tasks, or over `salts`, a column of both."""
    salts = F.col("salts") if "salts" in regions.columns else F.lit(SALTS)
    salted = regions.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return members.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).join(salted, ["region", "salt"]).drop("salt")


def _differences(members: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(region, id, n, apart array<long>, linked boolean): how the full set of each class differs from that of its hub."""
    sizes = members.groupBy("region").agg(F.least(F.lit(SALTS), F.ceil(F.count("*") * SALTS / ROWS)).cast("int").alias("salts"))  # a hub's set is sent once for each
    hubs = sizes.join(sets.toDF("region", "hub"), "region")
    both = _with_region(members.join(sizes, "region").join(sets, "id"), hubs)
    shared = F.size(F.array_intersect("hashes", "hub"))
    linked = _similar(threshold, shared, F.size("hashes") + F.size("hub") - shared)
    apart = F.concat(F.array_except("hashes", "hub"), F.array_except("hub", "hashes"))
    return both.select("region", "id", F.size("hashes").alias("n"), apart.alias("apart"), linked.alias("linked"))


def _across(apart: DataFrame, labels: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): components that a link joins, among the classes of each region; strays meet all others of their region in blocks."""
    labelled = apart.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = labelled.groupBy("region", "component").agg(F.count("*").alias("rows"), F.sum(F.size("apart")).alias("values"), F.max(F.col("id") == F.col("region")).alias("home"))
    blocks = lambda of: F.ceil(F.greatest(F.sum(F.when(of, F.col("rows"))) / ROWS, F.sum(F.when(of, F.col("values"))) / VALUES, F.lit(1.0))).cast("int")
    home = F.max(F.when(F.col("home"), F.col("component")))
    regions = parts.groupBy("region").agg(home.alias("home"), blocks(~F.col("home")).alias("left"), blocks(F.lit(True)).alias("right"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    labelled = _with_region(labelled, regions)
    block = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["region", "i", "j", "stray", "component", "n", "apart"]
    strays = labelled.where(F.col("component") != F.col("home")).withColumn("i", block(1, F.col("left"))).withColumn("j", every("right")).withColumn("stray", F.lit(True))
    others = labelled.withColumn("j", block(2, F.col("right"))).withColumn("i", every("left")).withColumn("stray", F.lit(False))
    num, den = threshold.numerator, threshold.denominator
    return strays.select(columns).union(others.select(columns)).groupBy("region", "i", "j").applyInPandas(lambda block: _merged(block, num, den), "a long, b long").distinct()


def _merged(block: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Components of a block that links between its strays and others join: (component, the smallest it reaches)."""
    a, b = block[block["stray"]], block[~block["stray"]]
    n_a, n_b = (x["n"].to_numpy(np.int64) for x in (a, b))
    total = n_a[:, None] + n_b[None, :]
    differ = a["apart"].str.len().to_numpy(np.int64)[:, None] + b["apart"].str.len().to_numpy(np.int64)[None, :] - 2 * _common(list(a["apart"]), list(b["apart"]))
    names, at = np.unique(np.concatenate([a["component"], b["component"]]), return_inverse=True)
    at_a, at_b = at[: len(a)], at[len(a) :]
    link = ((total - differ) * den >= (total + differ) * num) & (at_a[:, None] != at_b[None, :])
    low = np.arange(len(names))
    while link.any():
        before = low.copy()
        np.minimum.at(low, at_a, np.where(link, low[at_b][None, :], len(names)).min(1))
        np.minimum.at(low, at_b, np.where(link, low[at_a][:, None], len(names)).min(0))
        if (low == before).all():
            break
    joined = np.flatnonzero(low != np.arange(len(names)))
    return pd.DataFrame({"a": names[joined], "b": names[low[joined]]})


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of the sets on the left with each on the right."""
    rows = [np.repeat(np.arange(len(x)), list(map(len, x))) for x in (left, right)]
    values = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right)]
    both = np.intersect1d(*values)
    out = np.zeros((len(left), len(right)), np.float32)
    columns = []
    for k in (0, 1):
        at = np.minimum(np.searchsorted(both, values[k]), max(len(both) - 1, 0))
        held = both[at] == values[k] if len(both) else np.zeros(len(values[k]), bool)
        order = np.argsort(at[held], kind="stable")
        columns.append((at[held][order], rows[k][held][order]))
    for lo in range(0, len(both), COLUMNS):
        dense = []
        for (at, row), n in zip(columns, out.shape, strict=True):
            x, y = np.searchsorted(at, (lo, lo + COLUMNS))
            part = np.zeros((n, min(COLUMNS, len(both) - lo)), np.float32)
            part[row[x:y], at[x:y] - lo] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _likely(pairs: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs that pass the union-sketch estimate."""
    brief = classes.select("id", "n", "sketch")
    return pairs.join(brief.toDF("a", "n_a", "sketch_a"), "a").join(brief.toDF("b", "n_b", "sketch_b"), "b").where(_promising(threshold, "a", "b")).select("a", "b")


def _decided(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    both = pairs.join(sets.toDF("a", "hashes_a"), "a").join(sets.toDF("b", "hashes_b"), "b")
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return both.where(_similar(threshold, shared, F.size("hashes_a") + F.size("hashes_b") - shared)).select("a", "b")
