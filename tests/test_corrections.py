"""Operators against plain versions: delayed edges, frame formats, binary records, turns, sections, names."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.functions.channel import Along, edge_delay
from lapwing.operators import can, geo, resample, segment
from lapwing.sources import logs, tables


@pytest.mark.parametrize("mode", [-1, 0, 1])
def test_delayed_edges(spark, mode):
    rng = np.random.default_rng(8)
    v = [None if x == 2 else float(x) for x in rng.choice([0, 0, 0, 1, 1, 2], 200)]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(v)], "session_id string, i long, v double")
    got = [r["d"] for r in df.select("i", edge_delay(F.col("v"), Along(), 4, mode).alias("d")).orderBy("i").collect()]
    up = [bool(x) for x in v]
    want, rose, fell = [], -1, -1
    for k in range(200):
        was = up[k - 1] if k else False
        if up[k] and not was:
            rose = k + 4 * (mode == 0)
        if was and not up[k]:
            fell = k + 4 * (mode == 1)
        want.append(float(rose > fell if mode in (0, 1) else k >= 4 and up[k - 4]))
    assert got == want


def test_a_frame_belongs_to_its_format(spark):
    row = lambda fmt, name: {"frame_id": 5, "extended": fmt, "message": name, "signal": f"{name}.x", "start_bit": 0, "length": 8, "big_endian": False, "signed": False, "factor": 1.0, "offset": 100.0 * fmt, "mux_role": None, "mux_branch": None}
    frames = spark.createDataFrame([("s", 0.0, 0, 5, False, b"\x05"), ("s", 1.0, 1, 5, True, b"\x05"), ("s", 2.0, 2, 5, None, b"\x06")], "session_id string, t double, seq long, frame_id long, extended boolean, payload binary")
    both = {(r["seq"], r["channel"], r["v"]) for r in can.decode(frames, [row(False, "S"), row(True, "E")]).collect()}
    assert both == {(0, "S.x", 5.0), (1, "E.x", 105.0), (2, "S.x", 6.0)}
    assert {r["channel"] for r in can.decode(frames, [row(True, "E")]).collect()} == {"E.x"}  # the other format where it is the only one


def record(kind, size, mul, div, dec, shift, unit, at, n, following=0):
    return (struct.pack("<4I", 0, following, at, n) + struct.pack("<HHHHHHHh", 1, kind, size, 10, shift, mul, div, dec) + b"C".ljust(32, b"\0") + b"c".ljust(8, b"\0") + unit.ljust(24, b"\0")).ljust(124, b"\0")


def test_binary_records(spark, tmp_path):
    head = struct.pack("<16I", 0x40, 0, 64, *[0] * 13)
    files = {
        "wide": (record(5, 0, 1, 1, 0, 7, b"a unit of 20 letters", 188, 2), struct.pack("<2i", 70_000, -3), [70_000.0, -3.0]),
        "large": (record(0, 2, 40_000, 0, 1, 0, b"m", 188, 2), struct.pack("<2h", 1, -1), [4000.0, -4000.0]),
        "short": (record(0, 2, 1, 1, 0, 0, b"m", 188, 9), struct.pack("<2h", 1, 2), [1.0, 2.0]),
    }
    for name, (rec, data, _) in files.items():
        (tmp_path / f"{name}.ld").write_bytes(head + rec + data)
    (tmp_path / "bad.ld").write_bytes(b"no log")
    got = logs.read_binary_logs(spark, str(tmp_path)).orderBy("session_id", "i").collect()
    for name, (_, _, want) in files.items():
        assert [r["v"] for r in got if r["session_id"] == name] == want
    assert next(r["unit"] for r in got if r["session_id"] == "wide") == "a unit of 20 letters"
    assert [(r["session_id"], r["channel"]) for r in got if r["error"]] == [("bad", None)]


def test_turns_of_a_car_that_goes_back(spark):
    turns = np.concatenate([np.linspace(0, 2.2, 240), np.linspace(2.2, 1.7, 60), np.linspace(1.7, 3.6, 200)])
    t = np.arange(len(turns)) * 0.25
    rows = [("s", k, float(t[k]), math.cos(2 * math.pi * x), math.sin(2 * math.pi * x)) for k, x in enumerate(turns)]
    got = [tuple(r) for r in segment.winding_laps(spark.createDataFrame(rows, "session_id string, i long, t double, x double, y double")).orderBy("turn").select("turn", "start_t", "end_t", "complete").collect()]
    x, y = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    swept = np.unwrap(np.arctan2(y - y.mean(), x - x.mean())) / (2 * math.pi)
    swept -= swept[0]
    edges, last = [t[0]], -math.inf
    for k in range(1, int(swept[-1]) + 1):
        first = t[np.argmax(swept >= k)]
        if first - last > 8:
            edges.append(first)
            last = first
    edges.append(t[-1])
    assert [(a, b) for _, a, b, _ in got] == list(zip(edges, edges[1:], strict=False)) and len(got) > 3
    assert [c for *_, c in got] == [False, *[True] * (len(got) - 2), False]


def test_a_flat_measure_has_no_corners(spark):
    flat = spark.createDataFrame([("s", d, 0.0) for d in range(300)], "session_id string, d long, v double")
    assert [(r["kind"], r["start_m"], r["end_m"]) for r in segment.sections(flat).collect()] == [("straight", 0.0, 300.0)]


def test_kinds_of_tracks(spark):
    def kind(points, dt):
        return geo.classify_track(spark.createDataFrame([("s", k, k * dt, float(x), float(y)) for k, (x, y) in enumerate(points)], "session_id string, i long, t double, x double, y double")).first()["kind"]

    a = np.linspace(0, 2 * math.pi * 20, 2000)
    assert kind(zip(20 * np.cos(a), 20 * np.sin(a), strict=True), 0.1) == "figure8"
    assert kind(zip(200 * np.cos(a), 200 * np.sin(a), strict=True), 0.1) == "circuit"
    assert kind(zip(200 * np.cos(a), 2 * np.sin(a), strict=True), 0.1) == "runs"  # to and fro
    assert kind([(k, 0) for k in range(300)], 0.1) == "runs" and kind([(0, 0)] * 30, 0.1) == "runs"


def test_names_of_views_and_first_of_a_tick(spark):
    assert [tables.view_name(p) for p in ("/a/ Motor--Temp (1).parquet", "x/__.parquet", "Ab_C")] == ["motor_temp_1", "channel", "ab_c"]
    a = spark.createDataFrame([("s", 1.0 + 2e-7, 5.0), ("s", 1.0, 9.0), ("s", 2.0, 3.0)], "session_id string, t double, v double")
    got = {r["tick"]: (r["a"], r["b"]) for r in resample.outer_on_time(a, a.limit(0)).collect()}
    assert got == {1_000_000: (9.0, None), 2_000_000: (3.0, None)}
