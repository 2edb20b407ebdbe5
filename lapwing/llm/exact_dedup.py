"""Exact dedup with a cuckoo-filter index of live digests.

The index holds one live digest per distinct text. A row whose fingerprint the filter doesn't know
is new and goes in without a look at the content; a hit is verified against the content stored in
the bucket; when a row with a larger id comes, the old live digest is deleted and the new one
inserted. Each input partition folds its rows first, so a group that holds a third of all rows
sends one row per partition; the folded rows meet by digest and go through the index again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import stored

SLOTS, KICKS = 4, 200


class CuckooIndex:
    """Cuckoo filter over 16-bit fingerprints, with the keys and values behind it in buckets."""

    def __init__(self, buckets: int = 1024) -> None:
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]
        self.content: dict[int, list[list]] = {}  # by the first bits of the key: [key, value]
        self.resizes = 0

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[:2], "little") or 1

    def _places(self, key: bytes, mark: int) -> tuple[int, int]:
        one = int.from_bytes(key[2:6], "little") & self.mask
        return one, self._other(one, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def may_hold(self, key: bytes) -> bool:
        mark = self._print(key)
        one, two = self._places(key, mark)
        return mark in self.table[one] or mark in self.table[two]

    def find(self, key: bytes) -> list | None:
        """The [key, value] entry: the filter first, then the bucketed content."""
        if not self.may_hold(key):
            return None
        return next((e for e in self.content.get(int.from_bytes(key[:6], "little"), ()) if e[0] == key), None)

    def insert(self, key: bytes, value) -> None:
        self.content.setdefault(int.from_bytes(key[:6], "little"), []).append([key, value])
        if not self._place(key):
            self._resize()

    def delete(self, key: bytes) -> bool:
        """Takes a live key out of content and filter; False if it isn't live."""
        entry = self.find(key)
        if entry is None:
            return False
        bucket = self.content[int.from_bytes(key[:6], "little")]
        bucket.remove(entry)
        if not bucket:
            del self.content[int.from_bytes(key[:6], "little")]
        mark = self._print(key)
        one, two = self._places(key, mark)
        self.table[one if mark in self.table[one] else two].remove(mark)
        return True

    def _place(self, key: bytes) -> bool:
        mark = self._print(key)
        at, two = self._places(key, mark)
        if len(self.table[at]) >= SLOTS:
            at = two
        for k in range(KICKS):
            slot = self.table[at]
            if len(slot) < SLOTS:
                slot.append(mark)
                return True
            mark, slot[k % SLOTS] = slot[k % SLOTS], mark
            at = self._other(at, mark)
        return False

    def _resize(self) -> None:
        """Twice the buckets, filled again from the stored keys."""
        while True:
            self.resizes += 1
            size = 2 * (self.mask + 1)
            self.mask, self.table = size - 1, [[] for _ in range(size)]
            if all(self._place(key) for entries in self.content.values() for key, _ in entries):
                return

    def items(self) -> Iterator[list]:
        for entries in self.content.values():
            yield from entries


def _order(live) -> tuple:
    """Null ids below all others; of rows with one id the first row above."""
    if isinstance(live, dict):
        return live["id"] is not None, live["id"], -live["row"]
    return live is not None, live


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, live, size) to one row per digest, through the index."""
    index = CuckooIndex()
    schema = None
    for batch in batches:
        schema = batch.schema
        for key, live, size in zip(batch.column("digest").to_pylist(), batch.column("live").to_pylist(), batch.column("size").to_pylist(), strict=True):
            entry = index.find(key)
            if entry is None:
                index.insert(key, (live, size))
            elif _order(live) <= _order(entry[1][0]):
                entry[1] = (entry[1][0], entry[1][1] + size)
            else:  # a larger id: the old digest isn't live any more
                total = entry[1][1] + size
                index.delete(key)
                index.insert(key, (live, total))
    if schema is None:
        return
    block: list = []
    for entry in index.items():
        block.append((entry[0], *entry[1]))
        if len(block) == 10_000:
            yield _rows(block, schema)
            block = []
    if block:
        yield _rows(block, schema)


def _rows(block: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row if asked for, digest binary): SHA-256 of each text, A-Z lower-cased, null as empty."""
    names = ["id", *(["row"] if row_col else [])]
    rows = docs.select(F.col(id_col).alias("id"), *([F.col(row_col).alias("row")] if row_col else []), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = [hashlib.sha256((t.as_py() or b"").lower()).digest() for t in batch.column("text")]  # bytes.lower() changes A-Z only
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(hashed, pa.binary())], [*names, "digest"])

    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", digest binary")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of `docs`: (id, keep_id, group_size long, kept boolean, digest binary).

    Texts are equal when identical after lower-casing A-Z; null text equals the empty text. Of equal
    texts the row with the largest id stays. A null id sorts below all others; a group of null ids
    only has a null keep_id and its rows stay. Rows that repeat an id count each in group_size and
    share its verdict. With `row_col`, a long that is each row's own, it is returned too and exactly one
    row of a group stays, of those with the largest id the one with the smallest key. Other columns
    are left out, so their names can't clash.
    """
    keyed = stored(digests(docs, id_col, text_col, row_col), "digests")
    kind = keyed.schema["id"].dataType.simpleString()
    name = F.col("id")
    if row_col:
        kind, name = f"struct<id:{kind},row:bigint>", F.struct("id", F.col("row").cast("long").alias("row"))
    first = keyed.select("digest", name.alias("live"), F.lit(1).cast("long").alias("size")).mapInArrow(_fold, f"digest binary, live {kind}, size long")
    live = first.repartition("digest").mapInArrow(_fold, f"digest binary, live {kind}, size long")
    keep, kept = (F.col("live.id"), F.col("row") == F.col("live.row")) if row_col else (F.col("live"), F.col("id").eqNullSafe(F.col("live")))
    own = [F.col("row").alias(row_col)] if row_col else []
    return keyed.join(live, "digest").select(F.col("id").alias(id_col), *own, keep.alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), "digest")
