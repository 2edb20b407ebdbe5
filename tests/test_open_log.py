"""Kinds of files by their content, previews, frame tables with the recorder's columns, merged sessions as CSV."""

import gzip
import struct

import pytest

from lapwing.sources import logs
from lapwing.sources.tables import write_merged

FRAMES = (
    "序号,系统时间,时间标识,CAN通道,ID号,帧类型,帧格式,CAN类型,长度,数据\r\n"
    '0,="17:54:13.7,385.5,ch1,0x27,数据帧,标准帧,CAN,2,x| 01 0A\r\n'
    '1,="17:54:13.8,386.0,ch1,0x18FF,数据帧,扩展帧,CAN,1,x| FF\r\n'
    '2,="17:54:13.9,bad,ch1,0x27,数据帧,标准帧,CAN,1,x| 00\r\n'
)


def test_frame_tables_by_content(spark, tmp_path):
    path = tmp_path / "frames.csv"
    path.write_bytes(FRAMES.encode("gbk"))
    got = logs.open_log(spark, str(path)).orderBy("seq").collect()
    assert [(r["t"], r["frame_id"], r["extended"], bytes(r["payload"])) for r in got] == [(0.0, 0x27, False, b"\x01\x0a"), (0.5, 0x18FF, True, b"\xff")]
    assert logs.kind_of(FRAMES.encode("gbk"), "x.csv.gz") == "text"


def test_text_and_compressed_text(spark, tmp_path):
    body = b"time,Speed [km/h]\n0,1.5\n0.1,\n0.2,2.5\n"
    (tmp_path / "a.csv").write_bytes(body)
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(body))
    for name in ("a.csv", "b.csv.gz"):
        got = logs.open_log(spark, str(tmp_path / name)).orderBy("i").collect()
        assert [(r["session_id"], r["channel"], r["unit"], r["t"], r["v"]) for r in got] == [(name[0], "Speed", "km/h", t, v) for t, v in ((0.0, 1.5), (0.1, None), (0.2, 2.5))]
    assert logs.preview(spark, str(tmp_path / "a.csv"), 2).count() == 2
    assert logs.preview(spark, str(tmp_path / "a.csv")).where("error IS NOT NULL").count() == 0


def test_text_in_another_encoding(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("车速 [km/h],转速\n1.5,7\n2.5,8\n".encode("gbk"))
    got = logs.read_text(spark, str(tmp_path / "g.csv")).orderBy("channel", "i").collect()
    assert sorted((r["channel"], r["unit"], r["i"], r["v"]) for r in got) == sorted([("车速", "km/h", 0, 1.5), ("车速", "km/h", 1, 2.5), ("转速", "", 0, 7.0), ("转速", "", 1, 8.0)])


def test_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    for name in ("empty.csv", "missing.csv"):
        got = logs.preview(spark, str(tmp_path / name)).collect()
        assert len(got) == 1 and got[0]["error"] and got[0]["channel"] is None
    with pytest.raises(ValueError):
        logs.kind_of(b"", "x.ld.gz")
    assert logs.kind_of(struct.pack("<I", 0x40) + b"\0" * 60) == "binary"
    assert logs.kind_of(b'VERSION ""\nBO_ 39 A: 8 X\n') == "dbc"
    assert logs.kind_of(b"PAR1....") == "parquet"


def test_a_merged_session_comes_back(spark, tmp_path):
    rows = [(k / 10, float(k) if k % 3 else None, float("nan") if k == 4 else k * 2.5) for k in range(50)]
    wide = spark.createDataFrame(rows[::-1], "time double, `A B` double, C double")
    write_merged(wide, str(tmp_path / "m"), {"C": "V"})
    parts = sorted((tmp_path / "m").glob("part-*"))
    cells = [line.split(",") for p in parts for line in p.read_bytes().decode().split("\r\n") if line]
    body = [c for c in cells if c[0] not in ("time_s", "")]
    assert [c for c in cells if c[0] == "time_s"] == [["time_s", "A B", "C"]] * len(parts)
    assert [c for c in cells if c[0] == ""] == [["", "", "V"]] * len(parts)
    number = lambda v: "" if v is None or v != v else v
    assert [[float(c[0]), *(float(x) if x else "" for x in c[1:])] for c in body] == [[t, number(a), number(b)] for t, a, b in rows]
