"""Known answers: numbers that may be missing, spectra, filters, gates, sections, CAN, files."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.functions.channel import OPERATORS, SCALAR
from lapwing.functions.missing import divide, floor_mod, log_or_nan, present
from lapwing.operators import aggregate, can, geo, multi, segment
from lapwing.sources import logs, tables


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_arithmetic_that_never_raises(spark):
    x = F.lit
    got = one(spark, divide(x(1.0), x(0.0)), divide(x(-1.0), x(0.0)), divide(x(0.0), x(0.0)), floor_mod(x(7.0), x(-3.0)), floor_mod(x(-7.0), x(3.0)), log_or_nan(x(0.0)), log_or_nan(x(-1.0)), present(x(float("nan"))), SCALAR["round"](x(2.5)), SCALAR["int"](x(-2.7)), OPERATORS["=="](x(float("nan")), x(float("nan"))), OPERATORS["!="](x(float("nan")), x(1.0)))
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:5] == [-2.0, 2.0] and got[5] == -math.inf and math.isnan(got[6])
    assert got[7:] == [None, 2.0, -2.0, 0.0, 1.0]


def test_spectrum_of_a_sine(spark):
    t = np.arange(4096) / 100
    df = spark.createDataFrame([("s", "c", int(i), float(2 * math.sin(2 * math.pi * 6.25 * x))) for i, x in enumerate(t)], "session_id string, channel string, i long, v double")
    got = aggregate.welch(df, 100.0, 512).collect()
    top = max(got, key=lambda r: r["psd"])
    assert top["frequency"] == pytest.approx(6.25, abs=0.2)
    assert sum(r["psd"] for r in got) * 100 / 512 == pytest.approx(2.0, rel=0.05)


def test_lowpass_keeps_a_constant_and_stops_noise(spark):
    df = spark.createDataFrame([("s", "c", i, i / 100, 1.0 + (-1) ** i) for i in range(800)], "session_id string, channel string, i long, t double, v double")
    got = segment.lowpass(df, 2.0, 100.0, zero_phase=True).where("i between 300 and 500").agg(F.min("filtered"), F.max("filtered")).first()
    assert got[0] == pytest.approx(1, abs=0.02) and got[1] == pytest.approx(1, abs=0.02)


def circle(spark, laps=4, n=200):
    rows = [("s", k, k * 0.1, 50 * math.cos(2 * math.pi * k / n), 50 * math.sin(2 * math.pi * k / n)) for k in range(laps * n)]
    return spark.createDataFrame(rows, "session_id string, i long, t double, x double, y double")


def test_gates_and_turns_count_the_laps_of_a_circle(spark):
    track = circle(spark)
    gate = segment.debounce(segment.visits(track, 0.0, 50.0, 8.0), 8.0).collect()
    assert len(gate) == 4 and gate[1]["t"] - gate[0]["t"] == pytest.approx(20.0)
    line = segment.debounce(segment.line_crossings(track, 0.0, 40.0, 0.0, 60.0), 8.0).union(segment.debounce(segment.line_crossings(track, 0.0, 60.0, 0.0, 40.0), 8.0))
    assert line.count() == 4
    assert segment.winding_laps(track).count() == 4
    assert geo.classify_track(track).first()["kind"] == "circuit"
    assert geo.curvature(track).where("i between 5 and 700").agg(F.avg("curvature")).first()[0] == pytest.approx(1 / 50, rel=0.01)


def test_short_sections_are_absorbed(spark):
    v = [0.1] * 80 + [1.0] * 60 + [0.1] * 40 + [1.0] * 8 + [0.1] * 40 + [1.0] * 60
    grid = spark.createDataFrame([("s", d, x) for d, x in enumerate(v)], "session_id string, d long, v double")
    got = segment.sections(grid, smooth=1).orderBy("section").collect()
    assert [r["kind"] for r in got] == ["straight", "corner", "straight", "corner"]
    assert got[0]["start_m"] == 0 and got[-1]["end_m"] == len(v)


def test_lag_is_recovered(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=300).cumsum()
    a = spark.createDataFrame([("p", k, float(base[k])) for k in range(100, 200)], "pair string, k long, v double")
    b = spark.createDataFrame([("p", k + 7, float(base[k])) for k in range(300)], "pair string, k long, v double")
    assert multi.best_lag(multi.align(a, b, range(-20, 21))).first()["lag"] == 7


def reference_bits(payload: bytes, places: list[tuple[int, int]]) -> int:
    return sum(((payload[b] >> bit) & 1) << k for k, (b, bit) in enumerate(places))


def test_can_bits(spark):
    payload = bytes(range(17, 137, 15))
    df = spark.createDataFrame([(bytearray(payload),)], "p binary")
    for start, length, big in [(0, 8, False), (3, 13, False), (7, 16, True), (11, 12, True), (20, 30, False), (39, 9, True), (0, 64, False)]:
        want = reference_bits(payload, can.bit_places(start, length, big))
        got = df.select(can.raw_value(F.col("p"), start, length, big)).first()[0]
        assert got & (2**64 - 1) == want, (start, length, big)
    assert can.bit_places(7, 16, True)[::-1][:9] == [(0, k) for k in range(7, -1, -1)] + [(1, 7)]
    assert df.select(can.raw_value(F.col("p"), 60, 8)).first()[0] is None


def test_dbc_text(spark, tmp_path):
    (tmp_path / "a.dbc").write_text('BO_ 2147484000 Pack: 8 BMS\n SG_ Mode M : 0|4@1+ (1,0) [0|15] "" X\n SG_ Cell1 m0 : 8|12@1- (0.5,-1) [0|0] "mV" X\nBO_ 3221225472 P: 0 X\n SG_ Z : 0|1@1+ (1,0) [0|1] "" X\n')
    got = logs.read_dbc(spark, str(tmp_path / "a.dbc")).orderBy("start_bit").collect()
    assert [(r["signal"], r["frame_id"], r["extended"], r["mux_role"], r["mux_branch"], r["signed"], r["factor"]) for r in got] == [("Mode", 352, True, "M", None, False, 1.0), ("Cell1", 352, True, "m", 0, True, 0.5)]


def test_text_log(spark, tmp_path):
    (tmp_path / "run1.csv").write_text("Device;X\nTime;Speed [km/h];Note;Gear\n0.0;10;a;1\n0.1;20;b;2\n;30;c;3\n0.3;;d;4\n")
    got = logs.read_text(spark, str(tmp_path / "run1.csv")).orderBy("channel", "i").collect()
    assert [(r["session_id"], r["channel"], r["t"], r["v"]) for r in got] == [
        ("run1", "Gear", 0.0, 1.0), ("run1", "Gear", 0.1, 2.0), ("run1", "Gear", 0.3, 4.0), ("run1", "Speed", 0.0, 10.0), ("run1", "Speed", 0.1, 20.0), ("run1", "Speed", 0.3, None)
    ]


def test_binary_log(spark, tmp_path):
    head = struct.pack("<16I", 0x40, 0, 64, *[0] * 13)
    record = struct.pack("<4I", 0, 64, 188, 3) + struct.pack("<HHHHhhhh", 0, 0, 2, 10, 0, 1, 1, 1) + b"Speed".ljust(32, b"\0") + b"Spd".ljust(8, b"\0") + b"km/h".ljust(12, b"\0")
    (tmp_path / "a.ld").write_bytes(head + record.ljust(124, b"\0") + struct.pack("<3h", 10, -20, 30))
    got = logs.read_binary_logs(spark, str(tmp_path / "a.ld")).orderBy("i").collect()
    assert [(r["channel"], r["unit"], r["t"], r["v"]) for r in got] == [("Speed", "km/h", 0.0, 1.0), ("Speed", "km/h", 0.1, -2.0), ("Speed", "km/h", 0.2, 3.0)]


def test_sql_over_files(spark, tmp_path):
    spark.range(5).toDF("time").withColumn("v", F.col("time") * 2.0).write.parquet(str(tmp_path / "Run-1.parquet"))
    assert tables.run_sql(spark, "SELECT sum(v) FROM log JOIN run_1 USING (time)".replace("sum(v)", "sum(log.v)"), [str(tmp_path / "Run-1.parquet")]).first()[0] == 20
    assert tables.read_series(spark, str(tmp_path / "Run-1.parquet"), ["v"], 1, 3).count() == 3


def test_stats_leave_missing_out(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([float("nan"), 3.0, None, float("inf"), 1.0])], "k string, i long, v double")
    r = aggregate.stats(df, ["k"]).first()
    assert (r["min"], r["max"], r["start"], r["end"], r["change"], r["n"]) == (1.0, 3.0, 3.0, 1.0, -2.0, 2)


def test_live_windows_match_batch(spark, tmp_path):
    from lapwing.streaming.live import window_stats

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "c", k * 60, float(k)) for k in range(100)], "session_id string, channel string, s long, v double").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(src)
    batch = spark.read.parquet(src)
    q = window_stats(spark.readStream.schema(batch.schema).parquet(src), "10 minutes").writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, window_stats(batch, "10 minutes").collect()))


def test_entry_imports_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lapwing", tmp_path / "lapwing", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'channel_stats' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": "/root"})
