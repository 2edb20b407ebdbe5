"""Log files as samples: delimited text, binary logs, CAN frame tables, DBC files."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators.can import parse_dbc
from lapwing.sources.delimited import head_of, read_delimited

#: Columns of a recorder's table of CAN frames by role, its mark of extended frames, suffixes that may be compressed.
CAN_ROLES = {"index": "序号", "wall": "系统时间", "time": "时间标识", "bus": "CAN通道", "id": "ID号", "frame": "帧类型", "format": "帧格式", "protocol": "CAN类型", "length": "长度", "data": "数据"}
EXTENDED = "扩展"
COMPRESSIBLE = (".csv", ".txt", ".tsv")


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, or of what it holds if it is compressed; a task reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([head_of(p) for p in batch.column("path").to_pylist()], pa.binary())], ["head"])

    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1)
    return bytes(files.mapInArrow(run, "head binary").first()[0])


def kind_of(head: bytes, path: str = "") -> str:
    """The kind of a file by its first bytes: binary, parquet, dbc, can or text.

    A table of CAN frames has the recorder's columns for time, id and data, eight at least, and a wall time
    that starts with `="`; a compressed file never is one. Only delimited text may be compressed.
    """
    packed = path.lower().endswith(".gz")
    if packed and not path.lower()[:-3].endswith(COMPRESSIBLE):
        raise ValueError(f"{path}: only {', '.join(COMPRESSIBLE)} may be compressed")
    if head[:4] == b"PAR1":
        return "parquet"
    if len(head) >= 64 and head[:4] == struct.pack("<I", 0x40):
        return "binary"
    if re.search(rb"(?m)^\s*BO_\s+\d+\s", head):
        return "dbc"
    lines = [[c.strip() for c in line.split(",")] for line in head.decode("gbk", "ignore").splitlines()[:2]]
    framed = len(lines) == 2 and len(lines[0]) >= 8 and {CAN_ROLES[r] for r in ("time", "id", "data")} <= {*lines[0]}
    return "can" if framed and not packed and len(lines[1]) >= 8 and lines[1][1].startswith('="') else "text"


def open_log(spark: SparkSession, path: str) -> DataFrame:
    """A file by the reader its content asks for: samples, or frames of a CAN table, signals of a DBC, a wide Parquet session."""
    kind = kind_of(_head(spark, path), path)
    readers = {"binary": read_binary_logs, "can": read_can_table, "dbc": read_dbc, "text": read_text}
    return spark.read.parquet(path) if kind == "parquet" else readers[kind](spark, path)


def preview(spark: SparkSession, path: str, rows: int = 5000) -> DataFrame:
    """The first `rows` rows of a delimited log as `read_text` gives them, with `error`, null if it can be read.

    What keeps a file from being read is returned as one row with `error`, not raised.
    """
    schema = "session_id string, channel string, unit string, i int, t double, v double, error string"
    try:
        found = read_text(spark, path)
    except (PySparkException, IndexError, TypeError, ValueError) as e:
        return spark.createDataFrame([(None,) * 6 + (str(e).splitlines()[0] if str(e) else type(e).__name__,)], schema)
    return found.where(F.col("i") < rows).withColumn("error", F.lit(None).cast("string"))


def read_text(spark: SparkSession, path: str | list[str], session_id: str | None = None, rate: float | None = None) -> DataFrame:
    """Delimited logs as samples (session_id, channel, unit, i, t, v), by `delimited.read_delimited`, which raises what can't be read."""
    return read_delimited(spark, path, session_id, rate)


def read_binary_logs(spark: SparkSession, path: str) -> DataFrame:
    """Binary channel logs (64-byte header, linked 124-byte channel records, int16 or int32 samples) as samples; a file is a session.

    A file that can't be read gives one row with `error`, which is null elsewhere.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "session_id string, channel string, unit string, i long, t double, v double, error string"
    kinds = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")])

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, k.type) if (c := columns.get(k.name)) is None else pa.array(c if isinstance(c, np.ndarray) else [c] * n, k.type) for k in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                session = re.sub(r"\.\w+$", "", name.rsplit("/", 1)[-1])
                try:
                    for channel in channel_records(content.as_py()):
                        yield rows(len(channel["i"]), session_id=session, **channel)
                except (ValueError, struct.error) as e:
                    yield rows(1, session_id=session, error=str(e))

    return files.mapInArrow(run, schema)


#: Kinds of samples with 4 bytes.
FOUR_BYTES = (2, 4, 5)


def channel_records(content: bytes) -> Iterator[dict]:
    """The channels of one binary log; the list of records ends at 0 or where it would go round or leave the file.

    Samples have 4 bytes where the record says so by their size or kind, else 2. A channel whose samples
    lie beyond the file has those that are there. The record's shift isn't part of the value.
    """
    if len(content) < 64 or struct.unpack_from("<I", content, 0)[0] != 0x40:
        raise ValueError("not a binary channel log")
    at, seen = struct.unpack_from("<I", content, 8)[0], set()
    text = lambda b: b.split(b"\0")[0].decode("latin-1").strip()
    while at and at not in seen and at + 124 <= len(content):
        seen.add(at)
        _, following, data, n = struct.unpack_from("<4I", content, at)
        _, kind, size, rate, _, mul, div, dec = struct.unpack_from("<HHHHHHHh", content, at + 16)
        width = "<i4" if size == 4 or kind in FOUR_BYTES else "<i2"
        n = min(n, max(0, len(content) - data) // int(width[-1]))
        raw = np.frombuffer(content, width, n, data if n else 0).astype(float)
        v = raw * (mul / (div or 1)) / 10.0 ** max(-9, min(12, dec))
        i = np.arange(n)
        yield {"channel": text(content[at + 32 : at + 64]), "unit": text(content[at + 72 : at + 96]), "i": i, "t": i / max(rate, 1), "v": v}
        at = following


def read_can_table(spark: SparkSession, path: str, roles: dict[str, str] | None = None, encoding: str = "GBK", sep: str = ",") -> DataFrame:
    """A table of CAN frames as (part, seq, t, frame_id, extended, payload), `t` from each part's first frame.

    `roles` renames columns of CAN_ROLES: time, id, format, data. Rows without a time, an id or a payload that
    can be read are left out. Spark reads few encodings, so the file is read by bytes and names are put into them.
    """
    as_read = lambda text: text.encode(encoding).decode("latin-1")
    roles = {role: as_read(name).replace("`", "``") for role, name in (CAN_ROLES | (roles or {})).items()}
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("sep", sep).csv(path)
    cell = lambda role: F.trim(F.col(f"`{roles[role]}`"))
    payload = F.unhex(F.regexp_replace(F.regexp_replace(cell("data"), r"^x\|", ""), r"\s", ""))
    digits = F.regexp_extract(cell("id"), "^(?:0[xX])?([0-9A-Fa-f]+)$", 1)
    extended = F.lower(cell("format")).contains("ext") | cell("format").contains(as_read(EXTENDED))
    out = raw.select(
        F.input_file_name().alias("part"), F.monotonically_increasing_id().alias("seq"), cell("time").try_cast("double").alias("t"),
        F.when(digits != "", F.conv(digits, 16, 10).cast("long")).alias("frame_id"), extended.alias("extended"), payload.alias("payload"),
    ).where("t IS NOT NULL AND frame_id IS NOT NULL AND payload IS NOT NULL")
    zero = out.groupBy("part").agg(F.min("t").alias("t0"))
    return out.join(zero, "part").withColumn("t", F.col("t") - F.col("t0")).drop("t0")


def read_dbc(spark: SparkSession, path: str) -> DataFrame:
    """The signals of DBC files, by `parse_dbc`."""
    text = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("db"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return parse_dbc(text)
