"""CAN decoding by a table of definitions: every byte order, place and length against bit lists, selectors, formats, hold on an axis."""

import random

from lapwing.operators import can


def raw_of(payload, start, length, big, signed):
    places = can.bit_places(start, length, big)
    if any(b < 0 or b >= len(payload) for b, _ in places):
        return None
    v = sum(((payload[b] >> k) & 1) << n for n, (b, k) in enumerate(places))
    return v - (1 << length) if signed and v >> (length - 1) else v


def signal(frame_id, name, start, length, big=False, signed=False, factor=1.0, offset=0.0, role=None, branch=None, extended=False, message=None):
    return {"frame_id": frame_id, "extended": extended, "message": message or f"M{frame_id}", "signal": name, "start_bit": start, "length": length, "big_endian": big, "signed": signed, "factor": factor, "offset": offset, "mux_role": role, "mux_branch": branch}


def frames_of(spark, rows):
    return spark.createDataFrame([("s", float(k), k, i, e, bytearray(p)) for k, (i, e, p) in enumerate(rows)], "session_id string, t double, seq long, frame_id long, extended boolean, payload binary")


def check(spark, signals, rows):
    frames = frames_of(spark, rows)
    got = {(r["seq"], r["channel"]): r["v"] for r in can.decode(frames, signals).collect()}
    want = {}
    for k, (i, _, p) in enumerate(rows):
        for s in (s for s in signals if s["frame_id"] == i):
            v = raw_of(p, s["start_bit"], s["length"], s["big_endian"], s["signed"])
            if v is not None:
                want[k, s["signal"]] = v * s["factor"] + s["offset"]
    assert got == want


def test_every_place(spark):
    random.seed(4)
    signals, n = [], 0
    for frame_id in range(60):
        for _ in range(6):
            length, big = random.randint(1, 64), random.random() < 0.5
            start = random.randint(0, 63)
            places = can.bit_places(start, length, big)
            if max(b for b, _ in places) < 8:
                signals.append(signal(frame_id, f"s{n}", start, length, big, random.random() < 0.5, random.choice([1.0, 0.5, -2.0]), random.choice([0.0, -40.0])))
                n += 1
    assert n > 80
    check(spark, signals, [(random.randint(0, 65), False, bytes(random.randint(0, 255) for _ in range(random.choice([8, 8, 8, 3, 0])))) for _ in range(400)])


def test_long_payloads(spark):
    random.seed(5)
    signals = [signal(1, f"s{k}", random.randint(0, 64 * 8 - 1), random.randint(1, 64), random.random() < 0.5, random.random() < 0.5) for k in range(150)]
    signals = [s for s in signals if max(b for b, _ in can.bit_places(s["start_bit"], s["length"], s["big_endian"])) < 64]
    check(spark, signals, [(1, False, bytes(random.randint(0, 255) for _ in range(n))) for n in (64, 64, 20, 8, 48, 0)])


def test_selectors(spark):
    signals = [signal(1, "sel", 0, 8, role="M"), signal(1, "a", 8, 8, role="m", branch=0), signal(1, "b", 8, 8, role="m", branch=3), signal(1, "c", 16, 8), signal(2, "d", 0, 8, role="m", branch=0), signal(2, "e", 8, 8)]
    rows = [(1, False, [0, 5, 6]), (1, False, [3, 7, 8]), (1, False, [9, 1, 2]), (1, False, [9, 1, 2]), (2, False, [0, 4])]
    frames = frames_of(spark, rows)
    got = sorted((r["seq"], r["channel"], r["v"]) for r in can.decode(frames, signals).collect())
    assert got == [(0, "a", 5), (0, "c", 6), (0, "sel", 0), (1, "b", 7), (1, "c", 8), (1, "sel", 3), (2, "c", 2), (2, "sel", 9), (3, "c", 2), (3, "sel", 9), (4, "e", 4)]
    assert [tuple(r) for r in can.stray_selectors(frames, signals).collect()] == [("M1", 9, 2)]


def test_same_names_and_large_tables(spark, monkeypatch):
    signals = [signal(1, "x", 0, 8), signal(2, "x", 8, 8), signal(2, "y", 0, 4)]
    frames = frames_of(spark, [(1, False, [1, 2]), (2, True, [3, 4])])
    want = [(0, "M1.x", 1.0), (1, "M2.x", 4.0), (1, "y", 3.0)]
    assert sorted((r["seq"], r["channel"], r["v"]) for r in can.decode(frames, signals).collect()) == want
    monkeypatch.setattr(can, "BROADCAST_SIGNALS", 0)
    assert sorted((r["seq"], r["channel"], r["v"]) for r in can.decode(frames, signals).collect()) == want
    assert can.decode(frames, spark.createDataFrame([], can.SIGNAL)).collect() == []


def test_work_of_a_frame_is_its_messages_own(spark):
    """The plan is as long for a thousand definitions as for three."""
    size = lambda n: len(can.decode(frames_of(spark, [(1, False, [1])]), [signal(k, f"s{k}", 0, 8) for k in range(n)]).select("v")._jdf.queryExecution().optimizedPlan().toString().split("LocalRelation")[0])
    assert abs(size(1000) - size(3)) < 200


def test_hold_on_an_axis(spark):
    decoded = spark.createDataFrame([("s", 1.0, 1, "a", 5.0), ("s", 1.0, 2, "a", 6.0), ("s", 3.0, 3, "a", 7.0), ("s", 2.0, 4, "b", 1.0)], "session_id string, t double, seq long, channel string, v double")
    axis = spark.createDataFrame([("s", float(k)) for k in range(5)], "session_id string, t double")
    want = [("a", 0.0, 6.0), ("a", 1.0, 6.0), ("a", 2.0, 6.0), ("a", 3.0, 7.0), ("a", 4.0, 7.0), *[("b", float(k), 1.0) for k in range(5)]]
    for block in (None, 1.5):
        assert sorted((r["channel"], r["t"], r["v"]) for r in can.on_axis(decoded, axis, block).collect()) == want
    assert can.on_axis(decoded, axis).columns == ["session_id", "t", "channel", "v"]
