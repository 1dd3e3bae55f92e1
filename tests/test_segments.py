import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import segments
from logweir.operators.segments import assign_generations, generation_name, retain
from model import greedy

SIZES = "sink string, seq long, text_bytes long, json_bytes long"


@pytest.mark.parametrize("n, limit, longest, block, fan, carry", [
    (400, 300, 60, 5_000, 2, None),
    (600, 700, 60, 2_000, 2, (650, 30, 4)),
    (300, 50, 60, 3_000, 3, (50, 0, 2)),
    (300, 1, 9, 1_000, 4, None),
    (300, 200, 900, 9_000, 2, None),
    (300, 10**9, 60, 2_000, 2, (5, 5, 7)),
])
def test_exact_cuts_equal_the_sequential_rule(spark, monkeypatch, n, limit, longest, block, fan, carry):
    """Small blocks force several levels of folding; one sink holds most of the rows."""
    monkeypatch.setattr(segments, "FINE_FLOOR", 300)
    monkeypatch.setattr(segments, "FINE_LIMITS", 2)
    rng = random.Random(n + limit)
    rows, want = [], {}
    for sink, count, text, json in (("a", n, 1, 1), ("b", 40, 1, 0), ("c", 40, 0, 1)):
        sizes = [(text * rng.randint(1, longest), json * rng.randint(1, longest)) for _ in range(count)]
        seqs = sorted(rng.sample(range(3 * n), count))
        rows += [(sink, s, *z) for s, z in zip(seqs, sizes)]
        start = carry if carry and sink == "a" else (0, 0, 0)
        want |= {(sink, s): g for s, g in zip(seqs, greedy(sizes, limit, *start))}
    frame = spark.createDataFrame(rows, SIZES).repartition(4)
    before = None if carry is None else spark.createDataFrame(
        [("a", *carry)], "sink string, text_bytes long, json_bytes long, generation long"
    )
    got = assign_generations(frame, limit, before, block_bytes=block, fan_in=fan).collect()
    assert {(r.sink, r.seq): r.generation for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("small", [True, False])
def test_rows_come_out_in_runs(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(segments, "BROADCAST_FINE_BLOCKS", 0)
        monkeypatch.setattr(segments, "FINE_FLOOR", 300)
        monkeypatch.setattr(segments, "FINE_LIMITS", 2)
    rows = [(s, i, 7, 9) for i in range(400) for s in ("a", "b")]
    got = assign_generations(spark.createDataFrame(rows, SIZES).repartition(4), 100, sums={"pos": "json_bytes"})
    parts = got.select("sink", "seq", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    breaks = sum((a.sink, a.seq + 1) != (b.sink, b.seq) for a, b in zip(parts, parts[1:]))
    assert len(parts) == 800 and breaks <= 2 * len({r.part for r in parts})


def test_a_block_holds_no_more_than_a_task_can():
    assert segments.BLOCK_BYTES <= 64 << 20  # some 130,000 short messages


def test_one_byte_limit_gives_a_segment_per_row(spark):
    frame = spark.createDataFrame([("s", i, 2, 50) for i in range(3)], SIZES)
    got = assign_generations(frame, 1).orderBy("seq").collect()
    assert [r.generation for r in got] == [0, 1, 2]


def test_no_limit_is_one_segment(spark):
    frame = spark.createDataFrame([("s", i, 2, 50) for i in range(10)], SIZES)
    assert {r.generation for r in assign_generations(frame).collect()} == {0}
    mixed = frame.withColumn("m", F.when(F.col("seq") < 0, 1).cast("long"))
    assert {r.generation for r in assign_generations(mixed, F.col("m")).collect()} == {0}


def test_sink_without_outputs_stays_in_one_segment(spark):
    rows = [("none", i, 0, 0) for i in range(50)] + [("s", i, 0, 40) for i in range(10)]
    got = assign_generations(spark.createDataFrame(rows, SIZES), 100).orderBy("seq").collect()
    assert {r.generation for r in got if r.sink == "none"} == {0}
    assert [r.generation for r in got if r.sink == "s"] == [i // 3 for i in range(10)]


@pytest.mark.parametrize("keep, want", [(3, {2, 3, 4, 5}), (0, {0, 1, 2, 3, 4, 5}), (9, {0, 1, 2, 3, 4, 5})])
def test_retention(spark, keep, want):
    rows = spark.createDataFrame([("s", g) for g in range(6)] + [("t", 0)], "sink string, generation long")
    kept = retain(rows, keep)
    assert {r.generation for r in kept.filter("sink = 's'").collect()} == want
    assert kept.filter("sink = 't'").count() == 1
    ages = {r.generation: r.age for r in generation_name(rows).filter("sink = 's'").collect()}
    assert ages == {g: 5 - g for g in range(6)}
