"""Delimited logs: any number of files, each cut into byte ranges that tasks read on their own.

Spark lists the files; a task takes a range, finds encoding, delimiter, header, units and time column in the
first bytes of the range's file, and parses the lines that begin in the range. A first pass leaves a row
per range (rows, channels that aren't numbers, first time, errors), from which a window over a session's
ranges gives each range its first row number; the second pass reads the samples. No file, and no session,
goes through one task, unless it is compressed.

`DelimitedLogs` is the same as a data source: `spark.dataSource.register(DelimitedLogs)`, then
`spark.read.format("delimited_logs").load(folder)`.
"""

from __future__ import annotations

import codecs
import csv
import datetime
import fnmatch
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Delimiters and encodings in the order they are tried, names of a time column, the entry with a declared rate.
DELIMITERS = (",", "\t", ";", "|", " ")
ENCODINGS = ("utf-8-sig", "gbk", "latin-1")
TIME_NAMES = ("time", "t", "timestamp", "time_s", "seconds")
RATE_ENTRY = "sample rate"
HEAD, HEAD_ROWS, SNIFF_ROWS = 65536, 200, 60
RANGE_BYTES, PORTION_BYTES = 64 << 20, 4 << 20
DEFAULT_RATE = 100.0
GZIP = b"\x1f\x8b"
_NUMERAL = re.compile(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*")
_EPOCH = datetime.datetime(1970, 1, 1)


def open_file(path: str, **how):
    """A file of any store that Arrow opens, as a stream with `seek`."""
    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":/" in path else f"file://{path}")
    return store.open_input_file(name, **how)


def head_of(path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file, or of what it holds if it is compressed."""
    with open_file(path) as f:
        head = f.read(size)
    return zlib.decompressobj(31).decompress(head, size) if head[:2] == GZIP else head


def encoding_of(head: bytes) -> str:
    """By a byte order mark, else the first that the head can be read in (a character cut off at its end doesn't count)."""
    if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        return "utf-16-le" if head[:2] == codecs.BOM_UTF16_LE else "utf-16-be"
    for e in ENCODINGS:
        try:
            codecs.getincrementaldecoder(e)().decode(head)
        except UnicodeDecodeError:
            continue
        return e
    return ENCODINGS[-1]


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def split_line(line: str, sep: str) -> list[str]:
    """The cells of a line: runs of white space, or `sep` with quotes; a line whose quotes don't fit is cut at every `sep`."""
    if sep == " ":
        return line.split()
    if '"' not in line:
        return line.split(sep)
    try:
        return next(csv.reader([line], delimiter=sep))
    except (csv.Error, StopIteration):
        return line.split(sep)


def delimiter_of(text: str) -> str:
    """The delimiter that cuts the most lines into the same number of cells, wider ones counting more."""
    lines = [x for x in lines_of(text)[: 2 * SNIFF_ROWS] if x.strip()][:SNIFF_ROWS]

    def score(d: str) -> float:
        widths = Counter(w for w in (len(split_line(x, d)) for x in lines) if w > 1)
        return max((n / len(lines) * min(w, 64) for w, n in widths.most_common(1)), default=0.0)

    return max(DELIMITERS, key=score)


def distinct(names: Sequence[str]) -> list[str]:
    seen: Counter[str] = Counter()
    out = []
    for n in names:
        seen[n] += 1
        out.append(n if seen[n] == 1 else f"{n} ({seen[n]})")
    return out


def stamp(cell: str) -> float | None:
    """Seconds since 1970 of an ISO time, of one without zone as if it were UTC; None if it isn't one."""
    try:
        at = datetime.datetime.fromisoformat(cell.strip())
    except ValueError:
        return None
    return at.timestamp() if at.tzinfo else (at - _EPOCH).total_seconds()


@dataclass(frozen=True)
class Layout:
    """What the head of a file says: how to cut it, its channels and units, which column is the time (None: none) and how it is written."""

    encoding: str
    sep: str
    names: list[str]
    units: list[str]
    time: int | None
    stamped: bool
    rate: float | None
    head: frozenset[str]

    @property
    def unit(self) -> int:
        return 2 if self.encoding.startswith("utf-16") else 1

    @property
    def line_feed(self) -> bytes:
        return "\n".encode(self.encoding) if self.unit == 2 else b"\n"

    @classmethod
    def of(cls, head: bytes) -> Layout:
        encoding = encoding_of(head)
        text = head.decode(encoding, "ignore").lstrip("﻿")
        if not text.strip():
            raise ValueError("the file is empty")
        sep = delimiter_of(text)
        lines = lines_of(text)[:HEAD_ROWS]
        cells = [[c.strip() for c in split_line(x, sep)] for x in lines]
        numeric = [sum(bool(_NUMERAL.fullmatch(c.replace(",", ""))) for c in row) for row in cells]
        filled = [len([c for c in row if c]) for row in cells]
        at = max((k for k in range(len(cells)) if not numeric[k] and filled[k] > 1 and not any(stamp(c) for c in cells[k])), key=lambda k: (filled[k], -k), default=-1)
        width = max(map(len, cells))
        names = cells[at] if at >= 0 else [f"c{k}" for k in range(width)]
        below = cells[at + 1] if at >= 0 and at + 1 < len(cells) else []
        has_units = bool(below) and any(below) and not numeric[at + 1] and not any(stamp(c) for c in below)
        split = [re.fullmatch(r"(.*?)\s*\[(.*)\]", n) for n in names]
        units = [m[2] if m else u for m, u in zip(split, [*(below if has_units else []), *[""] * len(names)], strict=False)]
        names = distinct([m[1] if m else n for m, n in zip(split, names, strict=True)])
        time = next((k for k, n in enumerate(names) if n.lower() in TIME_NAMES), None)
        first = at + 1 + has_units
        times = [row[time] for row in cells[first:] if time is not None and time < len(row) and row[time]]
        stamped = bool(times) and not _NUMERAL.fullmatch(times[0].replace(",", ""))
        said = [c for row in cells[: max(at, 0)] for c in zip(row, row[1:], strict=False) if c[0].strip('"').lower() == RATE_ENTRY]
        rate = float(said[0][1]) if said and _NUMERAL.fullmatch(said[0][1]) and float(said[0][1]) > 0 else None
        return cls(encoding, sep, names, units, time, stamped, rate, frozenset(x for x in lines[:first]))


def _portions(stream: Iterator[bytes], start: int, end: int, layout: Layout, portion: int) -> Iterator[bytes]:
    """Whole lines that begin in [start, end), some megabytes at a time. `stream` gives the bytes from one code unit before `start` on."""
    feed, unit = layout.line_feed, layout.unit

    def find(held: bytearray, since: int) -> int:
        at = held.find(feed, since)
        while at >= 0 and at % unit:
            at = held.find(feed, at + 1)
        return at

    held, place = bytearray(), max(0, start - unit)
    if start:  # what began before isn't ours
        while (at := find(held, 0)) < 0:
            if not (more := next(stream, b"")):
                return
            held += more
        del held[: at + unit]
        place += at + unit
    while place < end:
        if len(held) < portion and (more := next(stream, b"")):
            held += more
            continue
        last = find(held, max(0, end - place - unit)) if place + len(held) >= end else held.rfind(feed)
        while last >= 0 and last % unit:
            last = held.rfind(feed, 0, last)
        if last < 0:
            if more := next(stream, b""):
                held += more
                continue
            last = len(held) - unit
        if last < 0:
            return
        yield bytes(held[: last + unit])
        place += last + unit
        del held[: last + unit]


def _bytes(path: str, start: int, unit: int, packed: bool, block: int) -> Iterator[bytes]:
    with open_file(path) as f:
        if not packed:
            f.seek(max(0, start - unit))
        unpack = zlib.decompressobj(31) if packed else None
        while data := f.read(block):
            while unpack is not None and data:
                yield unpack.decompress(data, block)
                data = unpack.unconsumed_tail
                if unpack.eof:  # another member
                    data, unpack = unpack.unused_data, zlib.decompressobj(31)
            if unpack is None:
                yield data
        if unpack is not None:
            yield unpack.flush()


def _columns(text: str, layout: Layout) -> list[pa.Array]:
    """The cells of whole lines by column, as strings, null where a line is too short; blank lines, those of the head and of one cell don't count."""
    width = len(layout.names)
    if '"' not in text and layout.sep != " ":
        kept = [x for x in lines_of(text) if x not in layout.head and layout.sep in x]
        if not kept:
            return []
        body = pa.py_buffer("\n".join(kept).encode())
        try:  # the fast way, where all lines have as many cells as the header
            got = pcsv.read_csv(
                pa.BufferReader(body), pcsv.ReadOptions(use_threads=False, column_names=[str(k) for k in range(width)], block_size=len(body) + 1), pcsv.ParseOptions(delimiter=layout.sep, quote_char=False),
                pcsv.ConvertOptions(column_types={str(k): pa.string() for k in range(width)}, strings_can_be_null=False),
            )
            return [c.combine_chunks() for c in got.columns]
        except pa.ArrowInvalid:
            rows = [x.split(layout.sep) for x in kept]
    else:
        rows = [c for c in (split_line(x, layout.sep) for x in lines_of(text) if x not in layout.head) if len(c) > 1]
    return [pa.array([r[k] if k < len(r) else None for r in rows], pa.string()) for k in range(width)] if rows else []


def _numbers(cells: pa.Array) -> tuple[np.ndarray, bool]:
    """Numbers (thousands may be set off by commas) with NaN for blank cells, and whether a cell is neither."""
    text = pc.replace_substring(pc.utf8_trim_whitespace(cells), ",", "")
    text = pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)
    try:
        return pc.cast(text, pa.float64()).to_numpy(zero_copy_only=False), False
    except pa.ArrowInvalid:
        out = pd.to_numeric(pd.Series(text.to_pylist(), dtype=object), errors="coerce").to_numpy(float)
        odd = np.isnan(out) & pc.is_valid(text).to_numpy(zero_copy_only=False)
        known = {"nan", "+nan", "-nan"}
        return out, any(x.lower() not in known for x in text.filter(pa.array(odd)).to_pylist())


def _times(cells: pa.Array, layout: Layout) -> np.ndarray:
    if not layout.stamped:
        return _numbers(cells)[0]
    return np.array([np.nan if c is None or (s := stamp(c)) is None else s for c in cells.to_pylist()], float)


def tables(path: str, start: int, end: int, layout: Layout, portion: int = PORTION_BYTES) -> Iterator[list[pa.Array]]:
    """The columns of the range's lines, in portions."""
    packed = path.endswith(".gz")
    stream = _bytes(path, start, layout.unit, packed, min(portion, 1 << 20))
    for data in _portions(stream, start, 1 << 62 if packed else end, layout, portion):
        if columns := _columns(data.decode(layout.encoding, "ignore").lstrip("﻿"), layout):
            yield columns


_PROFILE = "session_id string, path string, start long, end long, rows long, timed long, bad array<int>, first double, zoned boolean, mixed boolean, stamped boolean, error string"
_SAMPLES = "session_id string, channel string, unit string, i long, t double, v double"


def _zones(cells: pa.Array) -> set[bool]:
    """Whether the times among the cells have a zone: none, one or both answers."""
    text = pc.utf8_trim_whitespace(cells)
    times = text.filter(pc.fill_null(pc.match_substring_regex(text, r"^\d{4}-?(\d\d|W)"), False))
    return set(pc.unique(pc.match_substring_regex(times, r"([zZ]|[-+]\d\d:?\d\d)$")).to_pylist())


def profile_range(session: str, path: str, start: int, end: int, portion: int = PORTION_BYTES) -> tuple:
    """A row of _PROFILE."""
    layout = None
    try:
        layout = Layout.of(head_of(path))
        rows, timed, bad, first, zones = 0, 0, set(), None, set()
        for columns in tables(path, start, end, layout, portion):
            rows += len(columns[0])
            if layout.time is not None:
                t = _times(columns[layout.time], layout)
                known = t[np.isfinite(t)]
                timed += len(known)
                first = float(known[0]) if first is None and len(known) else first
                zones |= _zones(columns[layout.time]) if layout.stamped else set()
            bad |= {k for k, c in enumerate(columns) if k != layout.time and k not in bad and _numbers(c)[1]}
        return session, path, start, end, rows, timed if layout.time is not None else rows, sorted(bad), first, True in zones, len(zones) > 1, layout.stamped, None
    except (ValueError, OSError, zlib.error, UnicodeError) as e:
        return session, path, start, end, 0, 0, [], None, False, False, layout is not None and layout.stamped, str(e).splitlines()[0] or type(e).__name__


def read_range(r: dict, rate: float | None, portion: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The samples of a range; `r` has its first row number and what the profile says of its session."""
    layout = Layout.of(head_of(r["path"]))
    hertz, at = rate or layout.rate or DEFAULT_RATE, r["before"]
    for columns in tables(r["path"], r["start"], r["end"], layout, portion):
        i = np.arange(at, at + len(columns[0]))
        at += len(i)
        t = i / hertz if layout.time is None else _times(columns[layout.time], layout) - (r["origin"] or 0.0) * layout.stamped
        good = np.isfinite(t)
        where, when = pa.array(i[good]), pa.array(t[good])
        for k, cells in enumerate(columns):
            if k == layout.time or k in r["bad"]:
                continue
            v = _numbers(cells)[0][good]
            same = lambda x: pa.repeat(pa.scalar(x, pa.string()), len(where))
            values = [same(r["session_id"]), same(layout.names[k]), same(layout.units[k]), where, when, pa.array(v, mask=np.isnan(v))]
            yield pa.RecordBatch.from_arrays(values, ["session_id", "channel", "unit", "i", "t", "v"])


def session_name(path: str) -> str:
    return re.sub(r"\.\w+(\.gz)?$", "", path.rstrip("/").rsplit("/", 1)[-1])


def file_ranges(spark: SparkSession, path: str | list[str], session_id: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(session_id, path, start, end): files, folders or patterns cut into ranges; a compressed file is one range."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the content isn't read
    name = F.lit(session_id) if session_id else F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.\w+(\.gz)?$", "")
    whole = F.col("path").endswith(".gz")
    n = F.when(whole, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("length") / range_bytes))).cast("long")
    cut = files.select(name.alias("session_id"), "path", "length", whole.alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    start = F.col("k") * range_bytes
    return cut.select("session_id", "path", start.alias("start"), F.when(F.col("whole"), F.col("length")).otherwise(F.least(start + range_bytes, F.col("length"))).alias("end"))


def _spread(ranges: DataFrame) -> DataFrame:
    """A few ranges for each task; every range is some seconds of work."""
    n = ranges.count()
    return ranges.repartition(max(1, min(n, 10_000)), "path", "start") if n > 1 else ranges


def profile(spark: SparkSession, path: str | list[str], session_id: str | None = None, range_bytes: int = RANGE_BYTES, portion: int = PORTION_BYTES) -> DataFrame:
    """A row per range of the files, with `error` where it can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [profile_range(*x.values(), portion) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema=arrow, preserve_index=False)

    names = [c.split()[0] for c in _PROFILE.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _PROFILE.split(", ")])
    return _spread(file_ranges(spark, path, session_id, range_bytes)).mapInArrow(run, _PROFILE)


def placed(profiled: DataFrame) -> DataFrame:
    """Adds the first row number of each range in its session (`before`), the session's first time (`origin`), all its bad channels, and `error` of a whole session."""
    session = Window.partitionBy("session_id")
    along = session.orderBy("path", "start")
    file = Window.partitionBy("path")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zones = F.max("mixed").over(session) | (F.max(F.col("zoned").cast("int")).over(session) != F.min(F.when(F.col("timed") > 0, F.col("zoned").cast("int"))).over(session))
    error = F.coalesce(
        F.max("error").over(session),
        F.when(F.col("stamped") & F.coalesce(zones, F.lit(False)), "some times have a zone, others don't"),
        F.when((F.sum("rows").over(session) > 0) & (F.sum("timed").over(session) == 0), "no row has a time"),
    )
    return profiled.select(
        "session_id", "path", "start", "end", F.coalesce(F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"),
        F.first("first", True).over(whole).alias("origin"), F.array_distinct(F.flatten(F.collect_list("bad").over(file))).alias("bad"), error.alias("error"),
    )


def read_delimited(
    spark: SparkSession, path: str | list[str], session_id: str | None = None, rate: float | None = None, errors: str = "raise", range_bytes: int = RANGE_BYTES, portion: int = PORTION_BYTES
) -> DataFrame:
    """Delimited logs as samples (session_id, channel, unit, i, t, v); a file is a session, or all files are `session_id`, in the order of their names.

    The header is the widest row of the head without numbers, a row after it without numbers holds units, `Name [unit]`
    is split. Cells may be quoted. Channels with a cell that is neither blank nor a number are left out, as are
    rows without a time; blank cells, and those that a short line lacks, are missing samples. Times are seconds, or
    ISO times, which count from the session's first. Without a time column, rows are 1 / `rate` s apart (else by the rate
    that the file declares, else by 100 Hz). Empty files have no samples, and are raised if there are no others. What can't be read (no
    row with a time, times of which some have a zone, a file that doesn't open) is raised, or with errors="keep" returned as one row per session with `error`.
    Rows are numbered from 0 in each session. A session's bad channels are those of each of its files.
    """
    found = placed(profile(spark, path, session_id, range_bytes, portion)).persist()  # a row per range
    if errors == "raise" and found.isEmpty():
        raise ValueError(f"{path}: nothing to read, its files are empty")
    failed = found.where("error IS NOT NULL").groupBy("session_id").agg(F.min("error").alias("error"))
    if errors == "raise" and (first := failed.orderBy("session_id").first()):
        raise ValueError(f"{first['session_id']}: {first['error']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from read_range(r, rate, portion)

    samples = _spread(found.where("error IS NULL")).mapInArrow(run, _SAMPLES)
    if errors == "raise":
        return samples
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _SAMPLES.split(", ")[1:]]
    return samples.withColumn("error", F.lit(None).cast("string")).union(failed.select("session_id", *none, "error"))


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options.get("path", ""), int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[_Range]:
        store, at = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.path) if ":/" in self.path else f"file://{self.path}")
        folder, _, pattern = at.rpartition("/")
        plain = not re.search(r"[*?\[]", pattern)
        info = store.get_file_info(at) if plain else None
        if info is not None and info.type == fs.FileType.File:
            files = [info]
        else:
            inside = store.get_file_info(fs.FileSelector(at if plain else folder, recursive=plain))
            files = [f for f in inside if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and (plain or fnmatch.fnmatch(f.base_name, pattern))]
        scheme = self.path.split("://")[0] if "://" in self.path else "file"
        cut = lambda f: [(0, f.size)] if f.path.endswith(".gz") else [(k, min(k + self.size, f.size)) for k in range(0, max(f.size, 1), self.size)]
        return [_Range(f"{scheme}://{f.path}", a, b) for f in sorted(files, key=lambda f: f.path) for a, b in cut(f)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        session, at = session_name(partition.path), 0
        layout = Layout.of(head_of(partition.path))
        for columns in tables(partition.path, partition.start, partition.end, layout):
            n, t = len(columns[0]), None if layout.time is None else _times(columns[layout.time], layout)
            for k, cells in enumerate(columns):
                if k == layout.time:
                    continue
                v, same = _numbers(cells)[0], lambda x, kind=pa.string(): pa.repeat(pa.scalar(x, kind), n)  # noqa: B023
                when = pa.nulls(n, pa.float64()) if t is None else pa.array(t, mask=np.isnan(t))
                values = [same(session), same(layout.names[k]), same(layout.units[k]), same(partition.start, pa.int64()), pa.array(np.arange(at, at + n)), when, pa.array(v, mask=np.isnan(v))]
                yield pa.RecordBatch.from_arrays(values, ["session_id", "channel", "unit", "offset", "row", "t", "v"])
            at += n


class DelimitedLogs(DataSource):
    """Cells of delimited logs as they stand in the files: (session_id, channel, unit, offset, row, t, v).

    `offset` and `row` order a session's rows; `t` is in seconds, of ISO times since 1970, null where there is none.
    Cells that aren't numbers are null here. Option `range_bytes`: the size of a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "delimited_logs"

    def schema(self) -> str:
        return "session_id string, channel string, unit string, offset long, row long, t double, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
