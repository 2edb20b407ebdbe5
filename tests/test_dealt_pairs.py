"""Lags of pairs that are dealt once, and pairs without a usable sample."""

from lapwing.operators import pairing
from lapwing.plans import catalogue


def test_lines_are_shuffled_once_for_each_side(spark, monkeypatch):
    plans, settled = [], pairing.settled
    monkeypatch.setattr(pairing, "settled", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settled(df, name))
    got = catalogue.QUERIES["pair_lags"](spark, "/root/testdata/sf0.001")
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    wide = [sum("Exchange hashpartitioning(pair" in line and "REPARTITION" in line for line in p.splitlines()) for p in plans]
    assert plans[0].count("Exchange") == 2 and wide[0] == 2 and wide[1] == 2


def test_pairs_without_samples_stay(spark):
    kind = "pair long, channel string, t double, v double"
    speed = [(k, "speed", float(t), float(t * t % 61)) for k in (1, None) for t in range(400)]
    left = spark.createDataFrame([*speed, (2, "other", 0.0, 1.0), (3, "speed", 0.0, None), (4, None, 5.0, 1.0)], kind)
    right = spark.createDataFrame([*speed, (5, "other", 0.0, 1.0)], kind)
    expect = spark.createDataFrame([(1, 3.0)], "pair long, expect double")
    for asked in (None, expect):  # a sample holds for a second, and so does the lag
        got = {r["pair"]: (r["lag"] and int(r["lag"]), r["ok"], r["reason"]) for r in pairing.find_lags(left, right, expect=asked).collect()}
        assert got == {1: (0, True, None)} | dict.fromkeys((None, 2, 3, 4, 5), (None, False, "no common time to compare"))
