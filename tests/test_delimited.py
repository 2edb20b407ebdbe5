"""Delimited logs in byte ranges: quotes, encodings, ISO times, many files, errors; every cut gives the same samples."""

import gzip
import random

import pytest

from lapwing.sources import delimited, logs


def _got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Time,"Speed, front [km/h]",Gear,Note\n0.0,10,1,"a, b"\n0.1,"1,020.5",2,x\n0.2,"",3,"say ""hi"""\n0.3,40,4,"open\n')
    got = _got(logs.read_text(spark, str(tmp_path / "q.csv")), "channel", "unit", "i", "t", "v")
    front = [("Speed, front", "km/h", k, k / 10, v) for k, v in enumerate([10.0, 1020.5, None, 40.0])]
    assert got == sorted([("Gear", "", k, k / 10, k + 1.0) for k in range(4)] + front, key=repr) or sorted(map(repr, got)) == sorted(map(repr, front + [("Gear", "", k, k / 10, k + 1.0) for k in range(4)]))


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-be", "utf-8-sig", "gbk", "latin-1"])
@pytest.mark.parametrize("size", [1 << 20, 64])
def test_encodings_in_ranges(spark, tmp_path, encoding, size):
    name = "Allé 2" if encoding == "latin-1" else "车速ਊ" if encoding.startswith("utf") else "车速"  # U+0A0A holds bytes of a line feed
    body = f"time;{name} [km/h]\n" + "".join(f"{k / 10};{k * 1.5}\n" for k in range(60))
    data = b"\xfe\xff" + body.encode(encoding) if encoding == "utf-16-be" else body.encode(encoding)
    (tmp_path / "e.csv").write_bytes(data)
    got = delimited.read_delimited(spark, str(tmp_path / "e.csv"), range_bytes=size, portion=128)
    assert _got(got, "i", "channel", "unit", "t", "v") == [(k, name, "km/h", k / 10, k * 1.5) for k in range(60)]


def test_iso_times(spark, tmp_path):
    (tmp_path / "z.csv").write_text("Timestamp,v\n2024-05-01T10:00:00Z,1\n2024-05-01T12:00:00.5+02:00,2\n,3\nbad,4\n2024-05-01 10:00:02+00:00,5\n")
    (tmp_path / "n.csv").write_text("time,v\ns,V\n2024-05-01 10:00:00,1\n2024-05-01 10:00:01.25,2\n")
    (tmp_path / "m.csv").write_text("time,v\n2024-05-01 10:00:00,1\n2024-05-01 10:00:01Z,2\n")
    (tmp_path / "x.csv").write_text("time,v\nsoon,1\nlater,2\n")
    assert _got(logs.read_text(spark, str(tmp_path / "z.csv")), "i", "t", "v") == [(0, 0.0, 1.0), (1, 0.5, 2.0), (4, 2.0, 5.0)]
    assert _got(logs.read_text(spark, str(tmp_path / "n.csv")), "i", "t", "v", "unit") == [(0, 0.0, 1.0, "V"), (1, 1.25, 2.0, "V")]
    for name, what in (("m", "zone"), ("x", "no row has a time")):
        with pytest.raises(ValueError, match=what):
            logs.read_text(spark, str(tmp_path / f"{name}.csv"))
    kept = delimited.read_delimited(spark, str(tmp_path / "*.csv"), errors="keep").collect()
    assert sorted({(r["session_id"], r["error"]) for r in kept if r["error"]}) == [("m", "some times have a zone, others don't"), ("x", "no row has a time")]
    assert sum(r["error"] is None for r in kept) == 5


def test_rates(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Device,X\nSample Rate,20\na,b,c\n" + "1,2,3\n" * 5)
    (tmp_path / "p.txt").write_text("1  2\n3\t4 \n\n5  6\n")
    assert _got(logs.read_text(spark, str(tmp_path / "d.csv")).where("channel = 'a'"), "i", "t") == [(k, k / 20) for k in range(5)]
    assert _got(logs.read_text(spark, str(tmp_path / "d.csv"), rate=4.0).where("channel = 'a'"), "i", "t") == [(k, k / 4) for k in range(5)]
    assert _got(logs.read_text(spark, str(tmp_path / "p.txt")), "channel", "i", "t", "v") == [("c0", 0, 0.0, 1.0), ("c0", 1, 0.01, 3.0), ("c0", 2, 0.02, 5.0), ("c1", 0, 0.0, 2.0), ("c1", 1, 0.01, 4.0), ("c1", 2, 0.02, 6.0)]


def test_every_cut_gives_the_same(spark, tmp_path):
    random.seed(5)
    lines = ["t,a,b,c"] + [f"{k / 10},{random.choice(['', '1.5', '7'])},{k},{'x' if k == 400 else k}" + ("" if k % 7 else ",") for k in range(500)]
    (tmp_path / "c.csv").write_text("\r\n".join(lines))  # no line feed at the end
    path = str(tmp_path / "c.csv")
    whole = delimited.read_delimited(spark, path).collect()
    assert {r["channel"] for r in whole} == {"a", "b"} and [r["v"] for r in sorted(whole, key=lambda r: r["i"]) if r["channel"] == "b"] == [float(k) for k in range(500)]
    for size, portion in ((97, 1 << 20), (1000, 50), (1 << 20, 33)):
        assert sorted(map(repr, delimited.read_delimited(spark, path, range_bytes=size, portion=portion).collect())) == sorted(map(repr, whole))
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress("\r\n".join(lines).encode()[:5000]) + gzip.compress("\r\n".join(lines).encode()[5000:]))
    assert sorted(map(repr, delimited.read_delimited(spark, path + ".gz", portion=300).collect())) == sorted(map(repr, whole))


def test_a_thousand_files(spark, tmp_path):
    for k in range(1000):
        (tmp_path / f"f{k:04}.csv").write_text(f"time,v\n0,{k}\n1,{k + 0.5}\n")
    got = delimited.read_delimited(spark, str(tmp_path), range_bytes=16)
    assert _got(got, "session_id", "i", "t", "v") == [(f"f{k:04}", i, float(i), k + i / 2) for k in range(1000) for i in (0, 1)]
    one = delimited.read_delimited(spark, [str(tmp_path / f"f{k:04}.csv") for k in (3, 1)], session_id="all")
    assert _got(one, "session_id", "i", "v") == [("all", 0, 1.0), ("all", 1, 1.5), ("all", 2, 3.0), ("all", 3, 3.5)]


def test_no_single_task(spark, tmp_path):
    (tmp_path / "w.csv").write_text("time,v\n" + "".join(f"{k},{k}\n" for k in range(1000)))
    got = delimited.read_delimited(spark, str(tmp_path / "w.csv"), range_bytes=500)
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert got.rdd.getNumPartitions() > 4


def test_data_source(spark, tmp_path):
    spark.dataSource.register(delimited.DelimitedLogs)
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("time,v,w\n" + "".join(f"{k / 2},{k},x\n" for k in range(50)))
    got = spark.read.format("delimited_logs").option("range_bytes", "100").load(str(tmp_path)).where("channel = 'v'").orderBy("session_id", "offset", "row").collect()
    assert [(r["session_id"], r["t"], r["v"]) for r in got] == [(s, k / 2, float(k)) for s in "ab" for k in range(50)]
    assert spark.read.format("delimited_logs").load(str(tmp_path / "a*.csv")).where("v IS NULL AND channel = 'w'").count() == 50


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: lines at its ends, a hole of blanks-free nulls between, which is one line of one cell."""
    path = tmp_path / "big.csv"
    with open(path, "wb") as f:
        f.write(b"time,v\n0,1\n1,2\n")
        f.seek(2_300_000_000)
        f.write(b"\n2,3\n3,4\n")
    assert delimited.head_of(str(path))[:6] == b"time,v"
    ends = delimited.file_ranges(spark, str(path)).orderBy("start").collect()
    assert len(ends) == 35 and ends[-1]["end"] == path.stat().st_size
    last = ends[-1]
    layout = delimited.Layout.of(b"time,v\n0,1\n1,2\n")
    tail = [c for c in delimited.tables(str(path), path.stat().st_size - 9, last["end"], layout)]
    assert [c[1].to_pylist() for c in tail] == [["3", "4"]]
