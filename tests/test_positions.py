import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import positions
from logweir.operators.positions import (
    locate, log_summary, relative_positions, running_sums, with_positions,
)


@pytest.mark.parametrize("levels, bits", [(1, 16), (2, 4), (3, 3), (3, 16)])
def test_running_sums(spark, monkeypatch, levels, bits):
    monkeypatch.setattr(positions, "DIGIT_BITS", bits)
    rng = random.Random(levels * bits)
    rows = []
    for sink, n in (("a", 300), ("b", 40), ("c", 1)):
        for seq in rng.sample(range(1500), n):
            rows.append((sink, seq, rng.randrange(90), rng.randrange(5)))
    frame = spark.createDataFrame(rows, "sink string, seq long, x long, y long").repartition(5)
    want, totals = {}, {}
    for sink, seq, x, y in sorted(rows):
        px, py = totals.get(sink, (0, 0))
        want[sink, seq] = (px, py)
        totals[sink] = (px + x, py + y)
    got = running_sums(frame, {"px": "x", "py": "y"}, ["sink"], "seq", levels).collect()
    assert {(r.sink, r.seq): (r.px, r.py) for r in got} == want and len(got) == len(rows)


def test_no_window_spans_a_log(spark):
    frame = spark.range(10).select(F.col("id").alias("seq"), F.lit("x").alias("line"))
    plan = with_positions(frame)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[1]


def test_positions_count_bytes(spark):
    frame = spark.createDataFrame([(3, "é"), (1, ""), (2, "ab")], "seq long, line string")
    rows = with_positions(frame).orderBy("seq").collect()
    assert [(r.pos, r.nbytes) for r in rows] == [(0, 1), (1, 3), (4, 3)]
    assert log_summary(with_positions(frame)).collect() == [(7, 7)]
    assert log_summary(with_positions(frame.limit(0))).collect() == [(0, 0)]


def test_locate(spark):
    rows = [(4, 0, 10), (4, 10, 5), (5, 15, 20), (7, 35, 1)]
    logs = spark.createDataFrame(rows, "generation long, pos long, nbytes long")
    got = locate(logs, [0, 14, 15, 34, 35, 36, 99]).orderBy("position").collect()
    assert [tuple(r) for r in got] == [
        (0, 4, 0), (14, 4, 14), (15, 5, 0), (34, 5, 19), (35, 7, 0), (36, 7, 1), (99, 7, 1),
    ]
    assert locate(logs.limit(0), [0]).collect() == []


def test_relative_positions(spark):
    logs = spark.createDataFrame([("a", 50), ("a", 70), ("b", 9)], "sink string, pos long")
    got = {(r.sink, r.pos): r.rel_pos for r in relative_positions(logs).collect()}
    assert got == {("a", 50): 0, ("a", 70): 20, ("b", 9): 0}
