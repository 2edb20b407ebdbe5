"""A uniform shuffle into shards of exact sizes, by a communication matrix.

How many rows of each input partition go to each shard is drawn first, as a uniform permutation of all
rows would give it (the multivariate hypergeometric law with the partitions' and the shards' sizes
fixed), down a tree of partitions so that no task draws for all of them. Then partitions permute
their rows locally, deal them out by their line of the matrix, and shards permute what they got. Only
built-in functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import Scratch, stored

SHARDS, SEED = 24, 42
FANOUT = 16  # partitions, or groups of them, that one draw parts
BUCKET_ROWS = 20_000  # rows of a shard that are permuted in one sort
BROADCAST_BYTES = 32 << 20  # a larger matrix is joined by a shuffle
PLACE = (1 << 33) - 1


def hypergeometric(good: str, total: str, draws: str, u: str) -> str:
    """SQL of a hypergeometric draw: how many of `draws` rows, of `total` ones, are among the `good`. `u` is uniform in [0, 1).

    By inversion from near the mode: weights relative to it come from the ratio of neighbours, so no logarithm of a
    factorial loses digits at large totals. Ten standard deviations to each side are looked at, as far as they
    are possible outcomes; the chance beyond is below what a double can tell from 0.
    """
    low, high = f"greatest(0L, {draws} + {good} - {total})", f"least({draws}, {good})"
    spread = f"sqrt({draws} * ({good} / {total}) * (1 - {good} / {total}) * (({total} - {draws}) / greatest({total} - 1, 1)))"
    start = f"cast(greatest(a.low, least(a.high, floor(({draws} + 1.0D) * (({good} + 1.0D) / ({total} + 2.0D))))) as bigint)"
    up = f"(({good} - k) / (k + 1.0D)) * (({draws} - k) / ({total} - {good} - {draws} + k + 1.0D))"
    down = f"(k / ({good} - k + 1.0D)) * (({total} - {good} - {draws} + k) / ({draws} - k + 1.0D))"
    span = "sequence({0}, {1})"
    upper, lower = span.format("b.mode", "b.top"), "reverse(sequence(b.bottom, b.mode))"
    # the weight of k is known when k is reached; the last state holds the sum of all
    total_of = lambda ks, ratio: f"aggregate({ks}, named_struct('w', 1.0D, 's', 0.0D), (s, k) -> named_struct('w', s.w * {ratio}, 's', s.s + s.w), s -> s.s)"
    pick = lambda ks, ratio, u: (
        f"aggregate({ks}, named_struct('w', 1.0D, 's', 0.0D, 'k', b.mode), (s, k) -> named_struct('w', s.w * {ratio}, 's', s.s + s.w, "
        f"'k', if(s.s <= {u} and s.w > 0, k, s.k)), s -> s.k)"
    )
    bind = lambda name, value, then: f"transform(array({value}), {name} -> {then})[0]"
    choice = f"if({u} * (c.up + c.down - 1) < c.up, {pick(upper, up, f'{u} * (c.up + c.down - 1)')}, {pick(lower, down, f'{u} * (c.up + c.down - 1) - c.up + 1')})"
    sums = bind("c", f"named_struct('up', {total_of(upper, up)}, 'down', {total_of(lower, down)})", choice)
    ends = f"named_struct('mode', a.mode, 'bottom', greatest(a.low, a.mode - a.reach), 'top', least(a.high, a.mode + a.reach))"
    middle = bind("b", ends, sums)
    first = bind("a", f"named_struct('low', a.low, 'high', a.high, 'reach', a.reach, 'mode', {start})", middle)
    whole = bind("a", f"named_struct('low', {low}, 'high', {high}, 'reach', cast(ceil(10 * {spread}) + 10 as bigint))", first)
    return f"if({low} >= {high}, {high}, {whole})"


def uniform(*keys: str) -> str:
    """SQL of a number in [0, 1) that the keys decide."""
    return f"(shiftrightunsigned(xxhash64({', '.join(keys)}), 11) / 9007199254740992.0D)"


def split_counts(counts: str, sizes: str, *keys: str) -> Column:
    """An array of counts for each size: `counts` (per shard) parted as by a uniform shuffle into lots of `sizes`.

    Lots are drawn one after another from what is left, a lot's shards likewise. `keys` decide the draws.
    """
    bind = "transform(array({1}), {0} -> {2})[0]"
    h = hypergeometric("left_[j]", "t.total", "t.draws", uniform("m.k", "j", *keys))
    took = bind.format("h", h, "named_struct('draws', t.draws - h, 'total', t.total - left_[j], 'got', concat(t.got, array(h)))")
    none = "cast(array() as array<bigint>)"
    zero = f"named_struct('draws', m.size, 'total', aggregate(left_, 0L, (x, y) -> x + y), 'got', {none})"
    lot = bind.format("left_", "s.rest", f"aggregate(sequence(0, size(left_) - 1), {zero}, (t, j) -> {took}, t -> t.got)")
    step = bind.format("lot", lot, "named_struct('rest', zip_with(s.rest, lot, (x, y) -> x - y), 'lots', concat(s.lots, array(lot)))")
    lots = f"transform({sizes}, (size, k) -> named_struct('size', size, 'k', k))"
    return F.expr(f"aggregate({lots}, named_struct('rest', {counts}, 'lots', cast(array() as array<array<bigint>>)), (s, m) -> {step}, s -> s.lots)")


def communication_matrix(sizes: DataFrame, shards: int, seed: int, keep: Scratch) -> DataFrame:
    """(block, counts): how many rows of each block go to each shard, from (block, size). Lines add up to the blocks' sizes, columns to the shards'.

    Shards differ by one row at most, the first ones hold one more.
    """
    last = sizes.agg(F.max("block")).first()[0] or 0
    levels, width = [sizes.select(F.col("block").alias("node"), "size")], 1
    while width <= last:
        width *= FANOUT
        up = levels[-1].groupBy(F.expr(f"node div {FANOUT}").alias("node"))
        kids = F.sort_array(F.collect_list(F.struct((F.col("node") % FANOUT).alias("pos"), "size")))
        levels.append(keep(up.agg(F.sum("size").alias("size"), kids.alias("kids")), "sizes"))
    even = F.expr(f"transform(sequence(0, {shards - 1}), s -> size div {shards} + if(s < size % {shards}, 1L, 0L))")
    held = levels[-1].select("node", even.alias("counts"))
    for k in range(len(levels) - 1, 0, -1):
        at = held.join(levels[k].select("node", "kids"), "node").withColumn("lots", split_counts("counts", "kids.size", "node", f"{k}L", f"{seed}L"))
        held = at.select("node", "kids", F.posexplode("lots").alias("nth", "counts"))
        held = held.select((F.col("node") * FANOUT + F.col("kids")[F.col("nth")]["pos"]).alias("node"), "counts")
    return keep(held.withColumnRenamed("node", "block"), "matrix")


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of `docs` with `shard` (0 to shards - 1) and `slot` (from 0, without gaps, in each shard), a uniform shuffle of them.

    Every permutation is as likely as another; shards hold N div shards rows, or one more. The order depends on the
    seed and on how the table is parted, and is the same in every run over the same files and settings. Rows are
    told apart by their place, so nulls, repeated rows and equal texts are rows like others; equal texts aren't
    kept together, which exact sizes forbid. An empty table gives no rows; with fewer rows than shards, some shards
    are empty. Columns of `docs` named shard or slot are replaced. A shard's rows are sorted in buckets, so
    neither a partition nor a shard is ever one task beyond its bounded part.
    """
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    spark = docs.sparkSession
    with Scratch(spark) as keep:
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")), F.lit(0).alias("__"))
        local = docs.select(row.alias("row"), F.rand(seed).alias("first"), F.rand(seed + 1).alias("second")).sortWithinPartitions("first")
        rows = keep(local.select("row", "second", F.monotonically_increasing_id().alias("at")), "permuted")
        rows = rows.withColumn("block", F.shiftright("at", 33))
        sizes = keep(rows.groupBy("block").agg(F.count("*").alias("size")), "blocks")
        blocks, n = sizes.agg(F.count("*"), F.sum("size")).first()
        matrix = communication_matrix(sizes, shards, seed, keep)
        ends = F.expr("transform(counts, (x, i) -> aggregate(slice(counts, 1, i + 1), 0L, (a, b) -> a + b))")
        matrix = matrix.select("block", ends.alias("ends"))
        matrix = F.broadcast(matrix) if blocks * shards * 8 <= BROADCAST_BYTES else matrix
        place = F.col("at").bitwiseAND(F.lit(PLACE))
        shard = F.size(F.filter("ends", lambda e: e <= place)).alias("shard")
        buckets = max(1, -(-(n or 0) // (shards * BUCKET_ROWS)))
        dealt = rows.join(matrix, "block").select("row", shard, F.floor(F.col("second") * buckets).alias("bucket"), "second", "at")
        held = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("held"))
        before = held.select("shard", "bucket", F.expr("sum(held) OVER (PARTITION BY shard ORDER BY bucket) - held").alias("before"))
        nth = F.expr("row_number() OVER (PARTITION BY shard, bucket ORDER BY second, at) - 1")
        out = dealt.withColumn("nth", nth).join(before, ["shard", "bucket"])
        return stored(out.select("row.*", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot")).drop("__"), "shards")


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes what `shuffle_into_shards` returned, a folder per shard, files of `rows_per_file` rows at most in the order of slots."""
    part = F.expr(f"slot div {rows_per_file}")
    sharded.repartition("shard", part).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents: size is the text's UTF-8 bytes and 8, a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    got = shuffle_into_shards(slim, shards, seed)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
