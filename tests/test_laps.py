"""Gates, cuts and kinds of laps, against plain loops over small tracks."""

import math
from itertools import pairwise

import pytest

from lapwing.operators import laps, segment

RATE = 10.0
SCHEMA = "session_id string, i long, t double, x double, y double, speed double"


def ring(name, n, radius=60.0, speed=36.0, still=50, start=0.3):
    """`still` samples at rest, then n samples round a circle."""
    step = speed / 3.6 / RATE / radius
    a = [start] * still + [start + step * k for k in range(n)]
    return [(name, k, k / RATE, radius * math.cos(x), radius * math.sin(x), 0.0 if k < still else speed) for k, x in enumerate(a)]


def eight(name, loops, wide=13.0, high=18.0, speed=25.0):
    """Ellipses in turn about (-wide, 0) counter-clockwise and (wide, 0) clockwise, through the origin."""
    step, out, a, k = speed / 3.6 / RATE / 16, [], 0.0, 0
    while a < loops * 2 * math.pi:
        left = int(a // (2 * math.pi)) % 2 == 0
        c = a % (2 * math.pi)
        x, y = (-wide + wide * math.cos(c), high * math.sin(c)) if left else (wide - wide * math.cos(c), high * math.sin(c))
        out.append((name, k, k / RATE, x, y, speed))
        a, k = a + step, k + 1
    return out


def passages(rows, px, py, radius, first, span):
    """What a gate circle sees, sample by sample."""
    at = lambda k: math.atan2(rows[min(k + span, len(rows) - 1)][4] - rows[k][4], rows[min(k + span, len(rows) - 1)][3] - rows[k][3])
    d = [math.hypot(r[3] - px, r[4] - py) for r in rows]
    groups, out, last = [], [], -math.inf
    for k in range(first, len(rows)):
        if d[k] < radius and k > first:
            if d[k - 1] >= radius:
                groups.append([k])
            elif groups:
                groups[-1].append(k)
    for g in groups:
        k = min(g, key=lambda j: (d[j], j))
        if abs((at(k) - at(first) + math.pi) % (2 * math.pi) - math.pi) <= math.radians(75) and rows[k][2] - last > 8:
            out.append(rows[k][2])
            last = rows[k][2]
    return out


def test_candidates_by_hand(spark):
    rows = ring("a", 800)
    seen, before = {}, None
    for r in rows:
        if r[5] > 8:
            cell = (math.floor(r[3] / 10), math.floor(r[4] / 10))
            c = seen.setdefault(cell, [r[1], 0.0, 0.0, 0, 0])
            c[1], c[2], c[3], c[4] = c[1] + r[3], c[2] + r[4], c[3] + (cell != before), c[4] + 1
            before = cell
    mine = {r["first_i"]: (r["px"], r["py"], r["entries"]) for r in laps.gate_candidates(spark.createDataFrame(rows + ring("short", 9), SCHEMA)).where("session_id = 'a'").collect()}
    assert mine.keys() == {c[0] for c in seen.values()}
    for first, x, y, entries, n in seen.values():
        assert mine[first] == (pytest.approx(x / n), pytest.approx(y / n), entries)
    assert laps.gate_candidates(spark.createDataFrame(ring("short", 9), SCHEMA)).count() == 0


def test_gps_laps_by_hand(spark):
    rows = ring("a", 1800)
    df = spark.createDataFrame(rows + [("parked", k, k / RATE, 0.0, 0.0, 0.0) for k in range(60)], SCHEMA)
    found = laps.gps_laps(df, RATE).orderBy("session_id", "lap_index").collect()
    assert {r["session_id"] for r in found} == {"a"}
    c = laps.gate_candidates(df.where("session_id = 'a'")).where("entries >= 3").orderBy("first_i").first()
    diagonal = math.hypot(max(r[3] for r in rows) - min(r[3] for r in rows), max(r[4] for r in rows) - min(r[4] for r in rows))
    want = [t for t in passages(rows, c["px"], c["py"], max(6.0, min(30.0, 0.15 * diagonal)), c["first_i"], 10) if t >= rows[50][2]]
    assert [(r["start_t"], r["end_t"]) for r in found] == [e for e in pairwise([rows[50][2], *want, rows[-1][2]]) if e[1] > e[0]]
    assert len(want) >= 3 and [r["complete"] for r in found] == [False] + [True] * (len(found) - 2) + [False]


def test_a_given_gate(spark):
    rows = ring("a", 1800)
    got = [r["start_t"] for r in laps.gps_laps(spark.createDataFrame(rows, SCHEMA), RATE, spark.createDataFrame([("a", -60.0, 0.0)], "session_id string, px double, py double")).orderBy("lap_index").collect()]
    first = min(range(len(rows)), key=lambda k: math.hypot(rows[k][3] + 60, rows[k][4]))
    diagonal = math.hypot(120, 120)
    assert got == [rows[50][2], *passages(rows, -60.0, 0.0, 0.15 * diagonal, first, 10)]


def test_lines_by_hand(spark):
    rows = ring("a", 1800)
    gates = [("a", 60, *rows[60][3:5], 12.0), ("a", 300, *rows[300][3:5], 12.0), ("a", 300 + 10_000, 0.0, 0.0, 8.0)]
    got = laps.line_crossings(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(gates, "session_id string, first_i long, px double, py double, half double"), 10).collect()
    for _, first, px, py, half in gates[:2]:
        j = min(first + 10, len(rows) - 1)
        g = math.atan2(rows[j][4] - rows[first][4], rows[j][3] - rows[first][3])
        n = [(r[4] - py) * math.cos(g) - (r[3] - px) * math.sin(g) for r in rows]
        want, last = [], -math.inf
        for k in range(first, len(rows) - 1):
            if n[k] <= 0 < n[k + 1]:
                f = -n[k] / (n[k + 1] - n[k])
                x, y, t = (rows[k][c] + f * (rows[k + 1][c] - rows[k][c]) for c in (3, 4, 2))
                h = math.atan2(rows[min(k + 11, len(rows) - 1)][4] - rows[k + 1][4], rows[min(k + 11, len(rows) - 1)][3] - rows[k + 1][3])
                if abs((x - px) * math.cos(g) + (y - py) * math.sin(g)) <= half and abs((h - g + math.pi) % (2 * math.pi) - math.pi) <= math.radians(75) and t - last >= 8:
                    want.append(t)
                    last = t
        assert sorted(r["t"] for r in got if r["first_i"] == first) == [pytest.approx(t) for t in want] and want
    assert {r["first_i"] for r in got} == {60, 300}


def test_quality_of_a_cut(spark):
    rows = [("a", k, 20.0 * k, 20.0 * k + d, k not in (0, 5), w) for k, (d, w) in enumerate([(9.0, 300.0), (20.0, 400.0), (20.0, 400.0), (19.0, 410.0), (200.0, 400.0), (3.0, 100.0)])]
    q = laps.quality(spark.createDataFrame(rows, "session_id string, lap_index long, start_t double, end_t double, complete boolean, way_m double")).first()
    cv = lambda v: (sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)) ** 0.5 / (sum(v) / len(v))
    assert q["laps"] == 3 and q["variation"] == pytest.approx(cv([20, 20, 19]) + cv([400, 400, 410]))


def test_kinds_and_their_order(spark):
    line = [("runs", k, k / RATE, min(k, 80) * 1.0, 0.0, 36.0 if k < 80 or k > 160 else 0.0) for k in range(260)]
    rows = ring("ring", 1800) + eight("eight", 32) + line + ring("counted", 1800)
    df = spark.createDataFrame(rows, SCHEMA)
    counted = spark.createDataFrame([("counted", k, 30.0 * k, 30.0 * k + 30, 0 < k < 5) for k in range(6)], "session_id string, lap_index long, start_t double, end_t double, complete boolean")
    runs = segment.runs(df, df["speed"] > 3)
    found = laps.detect_laps(df, runs, RATE, counted).collect()
    assert {r["session_id"]: r["method"] for r in found} == {"ring": "gps", "eight": "figure8", "runs": "run", "counted": "counter"}
    assert sum(r["complete"] for r in found if r["session_id"] == "ring") >= 3
    turns = [r["turn"] for r in sorted(found, key=lambda r: r["start_t"]) if r["session_id"] == "eight" and r["complete"]]
    assert len(turns) >= 6 and all(a == -b for a, b in pairwise(turns))
    assert laps.detect_laps(df.where("false"), runs.where("false"), RATE).count() == 0


def test_beacons_and_missed_crossings(spark):
    df = spark.createDataFrame(ring("a", 1800), SCHEMA)
    b = spark.createDataFrame([("a", "west", -60.0, 0.0), ("a", "south", 0.0, -60.0)], "session_id string, beacon string, px double, py double")
    got = laps.beacon_laps(df, b, RATE).collect()
    assert {r["beacon"] for r in got} == {"west", "south"} and all(r["session_id"] == "a" for r in got)
    west = laps.gps_laps(df, RATE, spark.createDataFrame([("a", -60.0, 0.0)], "session_id string, px double, py double")).where("end_t - start_t >= 4").count()
    assert sum(r["beacon"] == "west" for r in got) == west
    base = spark.createDataFrame([("a", 0, 0.0, 40.0, False), ("a", 1, 40.0, 80.0, True)], "session_id string, lap_index long, start_t double, end_t double, complete boolean")
    missed = spark.createDataFrame([("a", 40.03), ("a", 20.0), ("a", 20.04), ("a", 60.0), ("b", 1.0)], "session_id string, t double")
    edges = laps.insert_crossings(base, missed).orderBy("lap_index").collect()
    assert [(r["start_t"], r["end_t"], r["complete"]) for r in edges] == [(0.0, 20.0, False), (20.0, 40.0, True), (40.0, 60.0, True), (60.0, 80.0, False)]
