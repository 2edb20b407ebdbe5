"""Merkle manifest of a table: a tree of hashes per group, a tree over the groups, a proof for every row.

Level by level with DataFrames: rows get their number within the group, `fanout` consecutive ones are
collected, sorted and hashed into their parent, and so on until one node is left. Coming down again, a
join per level appends each child's siblings to what its parent had, so a level moves as many rows as
it has families. Numbers come from a range partitioning and each partition's count, so a group that
holds a third of all rows isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import UPPER, Scratch, ascii_lower, stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a level adds to a proof: the siblings before and after the node.
SIDES = "array<struct<before:string,after:string>>"
PLACE = (1 << 33) - 1  # monotonically_increasing_id: the partition above, the place in it below


def field(col: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, `:`, the value."""
    text = col.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*cols: Column) -> Column:
    return F.sha2(F.concat(*map(field, cols)), 256)


def numbered(df: DataFrame, group: str, order: list[str], keep: Scratch) -> DataFrame:
    """Adds `i`, from 0 along `order` within the group, and `n`, the rows of the group. `group` is never null.

    Rows equal in `order` are told apart by the place where they were read, so many copies are spread too.
    """
    at = keep(df.withColumn("at", F.monotonically_increasing_id()), "rows")
    keys = [group, *order, "at"]
    sorted_ = at.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("at").withColumn("at", F.monotonically_increasing_id())
    rows = keep(sorted_, "sorted").withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit(PLACE)))
    parts = rows.groupBy("part", group).agg(F.min("place").alias("first"), F.count("*").alias("held"))
    over = f"OVER (PARTITION BY {group}"
    before = F.expr(f"sum(held) {over} ORDER BY part) - held - first")
    parts = parts.select("part", group, before.alias("shift"), F.expr(f"sum(held) {over})").alias("n"))
    return rows.join(parts, ["part", group]).withColumn("i", F.col("place") + F.col("shift")).drop("part", "place", "at", "shift")


def families(nodes: DataFrame, fanout: int, keep: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (g, i, n, digest, item): the families of each level (g, i, n, kids), and each group's top (g, level, digest, item)."""
    levels: list[DataFrame] = []
    kid = ["digest", "item"]
    tops = nodes.where("n = 1").select("g", F.lit(0).alias("level"), "digest", "item")
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        of = F.struct((F.col("i") % fanout).alias("pos"), *kid)
        got = nodes.where("n > 1").groupBy("g", F.expr(f"i div {fanout}").alias("i")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(of)).alias("kids"))
        got = keep(got.withColumn("n", F.expr(f"(n + {fanout - 1}) div {fanout}")), f"level{len(levels) + 1}")
        levels.append(got)
        nodes = got.withColumn("digest", F.sha2(F.array_join("kids.digest", ""), 256))
        none = F.lit(None).cast(tops.schema["item"].dataType)
        tops = tops.union(nodes.where("n = 1").select("g", F.lit(len(levels)), "digest", none))
        kid, most = ["digest"], -(-most // fanout)
    return levels, tops


def proofs(levels: list[DataFrame], tops: DataFrame, leaves: DataFrame, fanout: int) -> DataFrame:
    """(g, digest, item, sides, top) of each leaf: its siblings from the lowest level up, and what `tops` (g, level, sides, top) has of its group."""
    at = lambda k: tops.where(F.col("level") == k)
    held = at(len(levels)).select("g", F.lit(0).cast("long").alias("i"), "sides", "top")
    for k in range(len(levels), 0, -1):
        text = lambda c: F.array_join(c, "")
        own, kids = F.col("k"), F.col("kids.digest")
        side = F.struct(text(F.slice(kids, 1, F.col("nth"))).alias("before"), text(F.slice(kids, F.col("nth") + 2, F.size(kids))).alias("after"))
        family = levels[k - 1].join(held, ["g", "i"]).select("g", "i", "kids", "sides", "top", F.posexplode("kids").alias("nth", "k"))
        item = own["item"] if k == 1 else F.lit(None)
        down = family.select("g", (F.col("i") * fanout + own["pos"]).alias("i"), own["digest"].alias("digest"), item.alias("item"), F.concat(F.array(side), "sides").alias("sides"), "top")
        held = down if k == 1 else down.select("g", "i", "sides", "top").union(at(k - 1).select("g", F.lit(0).cast("long"), "sides", "top"))
    lone = leaves.where("n = 1").join(at(0).select("g", "sides", "top"), "g").select("g", "i", "digest", "item", "sides", "top")
    return (held.union(lone) if levels else lone).drop("i")


def fold(digest: Column, sides: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(sides, digest, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_digest(sides: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sides, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """One row per row of `docs`: (doc_id, leaf, subroot, root, sides, tampered_leaf).

    `sides` is the proof: an array of the siblings' digests before and after the node, from the leaf's level
    to the root, empty strings where a run is one node. `root` equals `fold(leaf, sides)`. `tampered` says which
    rows get a `tampered_leaf` made with `tampered_text` instead of their text; it is the leaf elsewhere.
    A null in any field counts as `-`, unlike the empty text (`0:`). Null ids come first in their group; rows
    that repeat an id are ordered by their digest. A null lang is a group of its own, the first. An empty
    table gives no rows; a single row is its own root, with an empty proof. Columns other than FIELDS are left out.
    """
    cols = {c: F.col(c) for c in FIELDS}
    own = leaf(*cols.values())
    changed = own if tampered is None else F.when(tampered, leaf(*(cols | {"text": tampered_text}).values())).otherwise(own)
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # null before all others, by bytes
    leaves = docs.select(group.alias("g"), "doc_id", own.alias("digest"), changed.alias("changed"))
    with Scratch(docs.sparkSession) as keep:
        rows = numbered(leaves, "g", ["doc_id", "digest"], keep)
        rows = rows.select("g", "i", "n", "digest", F.struct("doc_id", F.nullif("changed", "digest").alias("changed")).alias("item"))
        levels, subroots = families(rows, FANOUT, keep)
        subs = keep(subroots.select(F.lit("").alias("all"), "g", "level", "digest"), "subroots")
        subs = numbered(subs, "all", ["g"], keep).select(F.col("all").alias("g"), "i", "n", "digest", F.struct("g", "level").alias("item"))
        above, roots = families(subs, FANOUT, keep)
        roots = roots.select("g", "level", F.array().cast(SIDES).alias("sides"), F.col("digest").alias("top"))
        tops = proofs(above, roots, subs, FANOUT)
        tops = keep(tops.select("item.g", "item.level", "sides", F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top")), "tops")
        got = proofs(levels, tops, rows, FANOUT)
        out = got.select("item.doc_id", F.col("digest").alias("leaf"), "top.subroot", "top.root", "sides", F.coalesce("item.changed", "digest").alias("tampered_leaf"))
        return stored(out, "manifest")


def manifest_checks(docs: DataFrame) -> DataFrame:
    """The manifest with every third row (by the CRC-32 of its id) tampered with: A-Z of its text lower-cased.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the root folded from the tampered leaf
    and the original siblings, and whether it is the root. A text without A-Z stays what it is, and verifies.
    """
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    got = merkle_manifest(docs, third, ascii_lower(F.col("text")))
    folded = got.withColumn("folded_root", fold(F.col("tampered_leaf"), F.col("sides")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("sides")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEAF = "sha256(concat_ws('', {}))"


def oracle(levels: int = 6) -> str:
    """DuckDB SQL of `manifest_checks` for up to 8^levels rows of a language and 64 languages."""
    length = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    own = _LEAF.format(", ".join(map(length, FIELDS)))
    low = _LEAF.format(", ".join([*map(length, FIELDS[:-1]), length(f"translate(text, '{UPPER}', '{UPPER.lower()}')")]))
    # CRC-32 by bits: a step for each byte of the decimal, then eight shifts
    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""
    steps = [f"""a AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {own} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {low} ELSE {own} END AS bent FROM documents),
p0 AS (SELECT *, row_number() OVER w - 1 AS i, bent AS f, '' AS proof FROM a WINDOW w AS (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf)),
t0 AS (SELECT g, i, count(*) OVER (PARTITION BY g) AS n, leaf AS d FROM p0)"""]  # fmt: skip

    def climb(k: int, rows: str, nodes: str, out: str, up: str) -> None:
        steps.append(f"""s{out} AS (SELECT g, i // 8 AS i, n, list(d ORDER BY i) AS l FROM {nodes} GROUP BY g, i // 8, n),
t{up} AS (SELECT g, i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN l[1] ELSE sha256(array_to_string(l, '')) END AS d FROM s{out}),
p{up} AS (SELECT p.* EXCLUDE (i, f, proof), p.i // 8 AS i, CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(l[1:p.i % 8], '') || f || array_to_string(l[p.i % 8 + 2:], '')) END AS f,
    CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(l[1:p.i % 8], '') || array_to_string(l[p.i % 8 + 2:], '') END AS proof FROM {rows} p JOIN s{out} s ON p.g = s.g AND p.i // 8 = s.i)""")

    for k in range(levels):
        climb(k, f"p{k}", f"t{k}", str(k), str(k + 1))
    steps.append(f"""r0 AS (SELECT g, row_number() OVER (ORDER BY encode(g)) - 1 AS k, d AS subroot FROM t{levels}),
tz AS (SELECT '' AS g, k AS i, count(*) OVER () AS n, subroot AS d FROM r0),
pz AS (SELECT p.* EXCLUDE (g, i), '' AS g, r0.k AS i, subroot FROM p{levels} p JOIN r0 ON p.g = r0.g)""")
    climb(0, "pz", "tz", "y", "y")
    climb(1, "py", "ty", "x", "x")
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM px CROSS JOIN tx"
