"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A window is similar enough to an item only if they share word shingles, so windows of an item's
length that hold a shared shingle are slid over the text, except those whose shared shingles weigh
too little to reach the similarity with any item of the length (an exact prefilter: it loses
nothing). The 128-bit weighted SimHash of each window meets those of the items of its length
through a multi-index: 128 bits are cut into BLOCKS of (bits, flips), and each block of an item
stands there with all its neighbours of up to that many flipped bits. The flips plus one of all
blocks add up to more than RADIUS, so two fingerprints within RADIUS bits meet in a block at least;
of unrelated ones about 8 in 100 do. Fingerprints within the radius go to the exact weighted
similarity of the shingle sets. At a similarity of 0.8 the expected distance is 20 bits and its
standard deviation 4, so RADIUS finds about 97 of 100 windows right at the threshold and all but
few of those a little above.

Texts are told apart by SHA-256, so rows are judged one by one whatever their ids are, and equal
texts are looked at once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import stored

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 28
#: Bits of each block of the multi-index, and flipped bits up to which neighbours stand there.
BLOCKS = ((16, 3), (16, 3), *((14, 2),) * 5, *((13, 2),) * 2)
#: Bytes up to which a table that grows with the benchmark or its finds is broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 48 << 20
KEY = "__text_key"


def text_key(text: Column) -> Column:
    """What tells texts apart; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _side(df: DataFrame, row_bytes: int):
    """The hint for a stored table, by its size."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, width: int) -> Column:
    """Hashes of the runs of `width` words, by position; none if there are fewer words. `w` must be a column of its own, not an expression."""
    run = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), run)).otherwise(F.array().cast("array<bigint>"))


def _own_shingles(df: DataFrame, widths: list[int]) -> DataFrame:
    """Rows (width, w, ...) with `hashes`, the distinct shingles of their width."""
    by_width = F.coalesce(*(F.when(F.col("width") == n, shingles(F.col("w"), n)) for n in widths))
    return df.withColumn("hashes", F.array_distinct(by_width))


def simhash(votes: DataFrame, by: list[str]) -> DataFrame:
    """(by, fp array(long, long)) of rows (by, h, weight): 128 bits, of each whether the hashes that have it outweigh the others.

    A hash votes with the root of its weight, so fingerprints differ by the angle that the weighted
    similarity has. Sums of two bits share a long (32 bits each; roots count 256 at weight 1).
    """
    lanes, low = (1 << 32) | 1, (1 << 32) - 1
    cast = votes.withColumn("vote", F.greatest(F.round(F.sqrt("weight") * 256).cast("long"), F.lit(1))).withColumn("h1", F.xxhash64("h", F.lit(1)))
    sums = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(lanes)) * F.col("vote")).alias(f"{h}_{k}") for h in ("h", "h1") for k in range(32)]
    summed = cast.groupBy(*by).agg(F.sum("vote").alias("all"), *sums)

    def half(h: str) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            for at, part in ((k, F.col(f"{h}_{k}").bitwiseAND(F.lit(low))), (k + 32, F.shiftrightunsigned(f"{h}_{k}", 32))):
                out = out.bitwiseOR(F.when(part * 2 > F.col("all"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
        return out

    return summed.select(*by, F.array(half("h"), half("h1")).alias("fp"))


def blocks(fingerprint: Column) -> Column:
    """(block, bits) for each block of the multi-index."""

    def bits(lo: int, hi: int) -> Column:
        out = F.lit(0).cast("long")
        for word in (0, 1):
            a, b = max(lo, 64 * word), min(hi, 64 * word + 64)
            if a < b:
                part = F.shiftrightunsigned(F.get(fingerprint, F.lit(word)), a - 64 * word).bitwiseAND(F.lit((1 << (b - a)) - 1))
                out = out.bitwiseOR(F.shiftleft(part, a - lo))
        return out

    ends = [sum(n for n, _ in BLOCKS[: k + 1]) for k in range(len(BLOCKS))]
    return F.array(*(F.struct(F.lit(k).alias("block"), bits(end - BLOCKS[k][0], end).alias("bits")) for k, end in enumerate(ends)))


def flips(spark: SparkSession) -> DataFrame:
    """(block, flip): the bit masks of each block's neighbours, itself included; about 2,100 rows."""
    masks = [(k, sum(1 << b for b in chosen)) for k, (n, most) in enumerate(BLOCKS) for m in range(most + 1) for chosen in combinations(range(n), m)]
    return spark.createDataFrame(masks, "block int, flip long")


def meeting(windows: DataFrame, items: DataFrame, on: list[str]) -> DataFrame:
    """The rows (on, window columns, own_fp) with the items (on, item, fp) that share a block, once each."""
    near = items.select(*on, "item", F.explode(blocks(F.col("fp"))).alias("b")).select(*on, "item", "b.*").join(F.broadcast(flips(items.sparkSession)), "block")
    near = near.select(*on, "item", "block", F.col("bits").bitwiseXOR(F.col("flip")).alias("bits"))
    own = windows.select("*", F.explode(blocks(F.col("own_fp"))).alias("b")).select(*windows.columns, "b.*")
    return own.join(near, [*on, "block", "bits"]).drop("block", "bits")


def distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in (0, 1)), F.lit(0))


def _promising(seeds: DataFrame, similarity: float) -> DataFrame:
    """(key, width, length, start): the windows that can be similar enough, by their shared shingles.

    Of a window similar enough to an item, the shared shingles weigh `similarity` of the item at least,
    and similarity / (1 - similarity) of each shingle that is the window's own; both weigh `similarity`
    of the union. Places are dealt into
    pieces of a window's length; a window lies in two pieces next to each other, so no array is longer.
    """
    piece = F.floor(F.col("at") / F.col("length")).cast("int")
    dealt = seeds.withColumn("piece", F.explode(F.array_distinct(F.array(piece, F.greatest(piece - 1, F.lit(0))))))
    hit = F.struct("at", "h", "weight")
    held = dealt.groupBy("key", "n", "width", "length", "piece").agg(F.collect_set(hit).alias("hits"), F.min("least").alias("least"))
    span = F.col("length") - F.col("width")  # from a window's first shingle to its last
    last = F.greatest(F.lit(0), F.col("n") - F.col("length"))
    total = lambda hits: F.aggregate(F.array_distinct(F.transform(hits, lambda x: F.struct(x["h"].alias("h"), x["weight"].alias("weight")))), F.lit(0.0), lambda s, x: s + x["weight"])
    held = held.where(total(F.col("hits")) >= F.col("least") - 1e-9)
    low = F.greatest(F.col("piece") * F.col("length"), F.array_min(F.transform("hits", lambda x: x["at"])) - span)
    low = F.least(low, last)
    high = F.least((F.col("piece") + 1) * F.col("length") - 1, F.array_max(F.transform("hits", lambda x: x["at"])), last)
    held = held.withColumn("start", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    inside = held.withColumn("hits", F.filter("hits", lambda x: (x["at"] >= F.col("start")) & (x["at"] <= F.col("start") + span)))
    places = F.least(span + 1, F.col("n") - F.col("width") + 1)
    shared = total(F.col("hits"))
    own = F.when(F.size(F.array_distinct(F.transform("hits", lambda x: x["at"]))) < places, F.lit(1.0)).otherwise(F.lit(0.0))  # at least so many
    least = F.greatest(F.col("least") + similarity * own, own * (similarity / (1 - similarity) if similarity < 1 else float(1 << 60)))
    return inside.where((F.size("hits") > 0) & (shared >= least - 1e-9)).select("key", "width", "length", "start").distinct()


def _leaks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, width: int, similarity: float) -> DataFrame:
    """(key, item, start, length, similarity): each item that a text holds, with its most similar window, by text."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0).withColumn("length", F.size("w")).withColumn("width", F.least(F.lit(width), "length"))
    items = stored(items.withColumn("row", F.monotonically_increasing_id()), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # as many as `width` at most
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    if not widths:
        return texts.select("key", F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0.0).alias("similarity")).limit(0)

    items = stored(_own_shingles(items, widths).drop("w"), "items")
    parts = items.select("row", "width", "length", F.explode("hashes").alias("h"))
    weights = stored(parts.groupBy("width", "h").agg((1 / F.count("*")).alias("weight")), "weights")
    parts = stored(parts.join(weights, ["width", "h"]), "parts")
    held = parts.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("h", "weight"))).alias("weight"), F.sum("weight").alias("sum"))  # of one item
    items = stored(items.join(held, "row").join(simhash(parts, ["row"]), "row"), "fingerprints")

    # by width, length and shingle: its weight, and the least weight that a window shares with an item of the length
    least = items.groupBy("width", "length").agg((similarity * F.min("sum")).alias("least"))
    known = _side(stored(parts.select("width", "length", "h", "weight").distinct().join(least, ["width", "length"]), "known"), 64)
    rows, seeds = texts.select("key", words(F.col("text")).alias("w")), None
    for n in widths:
        here = rows.select("key", F.size("w").alias("n"), F.posexplode(shingles(F.col("w"), n)).alias("at", "h")).join(known.where(F.col("width") == n).drop("width"), "h")
        here = here.select("key", "n", F.lit(n).alias("width"), "length", "at", "h", "weight", "least")
        seeds = here if seeds is None else seeds.union(here)
    windows = stored(_promising(seeds, similarity), "windows")
    found = _side(stored(windows.groupBy("key").agg(F.collect_list(F.struct("width", "length", "start")).alias("windows")), "found"), 200)  # windows of one text
    cut = texts.join(found, "key").select("key", words(F.col("text")).alias("w"), F.explode("windows").alias("x"))
    cut = cut.select("key", "x.*", F.slice("w", F.col("x.start") + 1, F.col("x.length")).alias("w")).dropDuplicates(by := ["key", "width", "length", "start"])  # of equal texts once
    cut = stored(_own_shingles(cut, widths).select(*by, F.col("hashes").alias("own")), "cut")
    votes = cut.select(*by, F.explode("own").alias("h")).join(_side(weights, 64), ["width", "h"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    prints = stored(simhash(votes, by).withColumnRenamed("fp", "own_fp"), "fingerprints")
    met = meeting(prints, items.select(F.col("row").alias("item"), "width", "length", "fp"), ["width", "length"]).distinct().withColumnRenamed("item", "row")
    both = met.join(cut, by).join(items.select("row", "item", "hashes", "weight", "fp"), "row")
    both = both.where(distance(F.col("fp"), F.col("own_fp")) <= RADIUS)
    total = lambda hashes: F.aggregate(hashes, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at("weight", x), F.lit(1.0)))
    both = both.withColumn("similarity", total(F.array_intersect("own", "hashes")) / total(F.array_union("own", "hashes"))).where(F.col("similarity") >= similarity)
    best = both.groupBy("key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "length")).alias("b"))
    return best.select("key", "item", (-F.col("b.back")).alias("start"), F.col("b.length").alias("length"), F.col("b.similarity").alias("similarity"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, item_id, start, length, similarity): each item that a row of `docs` holds, with its most similar window.

    Similarity is the weight of the shared shingles over that of all, of the sets of shingles of
    `width` words; a shingle of the item weighs one over the number of items that have it, others 1.
    An item of fewer words is one shingle. Items without words (null or empty) match nothing, empty
    documents hold nothing. Rows are judged one by one, so ids may repeat or be null. Windows at a
    document's end are as short as it is. Other columns are left out. Of equally similar windows
    the first is returned.
    """
    leaks = _leaks(docs, benchmark, text_col, item_col, item_text_col, width, similarity).withColumnRenamed("item", "item_id")
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    return rows.join(leaks, "key").select(F.col("id").alias(id_col), "item_id", "start", "length", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: (id, contaminated boolean, item_ids array, similarity double)."""
    leaks = _leaks(docs, benchmark, text_col, item_col, item_text_col, width, similarity)
    by_text = leaks.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("similarity").alias("best"))
    out = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key")).join(_side(stored(by_text, "leaks"), 200), "key", "left")
    none = F.array().cast(by_text.schema["item_ids"].dataType)
    return out.select(F.col("id").alias(id_col), F.col("best").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("best", F.lit(0.0)).alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns."""
    leaks = stored(_leaks(docs, benchmark, text_col, item_col, item_text_col, width, similarity).select(F.col("key").alias(KEY)).distinct(), "leaks")
    return docs.withColumn(KEY, text_key(F.col(text_col))).join(_side(leaks, 100), KEY, "left_anti").drop(KEY)
