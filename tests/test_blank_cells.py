"""Delimited logs with blank cells and short lines."""

from lapwing.sources import logs


def test_blank_cells_and_short_lines_are_missing_samples(spark, tmp_path):
    (tmp_path / "run2.csv").write_text('Time;Speed [km/h];Temp [C];Note\n0.0;10;80;a\n0.1;20; ;b\n0.2;"";81;c\n0.3;40\n0.4;50;82;d\n')
    got = logs.read_text(spark, str(tmp_path / "run2.csv")).orderBy("channel", "i").collect()
    assert [(r["channel"], r["unit"], r["t"], r["v"]) for r in got] == [
        ("Speed", "km/h", 0.0, 10.0), ("Speed", "km/h", 0.1, 20.0), ("Speed", "km/h", 0.2, None), ("Speed", "km/h", 0.3, 40.0), ("Speed", "km/h", 0.4, 50.0),
        ("Temp", "C", 0.0, 80.0), ("Temp", "C", 0.1, None), ("Temp", "C", 0.2, 81.0), ("Temp", "C", 0.3, None), ("Temp", "C", 0.4, 82.0),
    ]
