import os

import pytest
from pyspark.sql import functions as F

from logweir.functions.predicates import LogFilter
from logweir.operators import paging
from logweir.schemas import ROUTE
from logweir.sources import sinks
from logweir.sources.chain import chain_positions, parse_jsonl, read_log_chain
from logweir.sources.log_table import LogTable
from logweir.sources.sinks import drop_expired, read_logs, write_jsonl, write_logs, write_text
from model import record


def put(folder, name, data: bytes):
    (folder / name).write_bytes(data)


def chain(spark, path, max_files=10):
    rows = chain_positions(read_log_chain(spark, str(path), max_files)).orderBy("pos").collect()
    return [(r.age, r.pos, r.line) for r in rows]


def test_chain_order_and_bytes(spark, tmp_path):
    put(tmp_path, "log.2.jsonl", b'{"n":0}\n{"n":1}\r\n\n{"n":2}\n')
    put(tmp_path, "log.1.jsonl", b"")
    put(tmp_path, "log.jsonl", '{"n":"é"}\nlast without newline'.encode())
    put(tmp_path, "log.11.jsonl", b"too old\n")
    put(tmp_path, "log.x.jsonl", b"no generation\n")
    put(tmp_path, "logs.jsonl", b"another log\n")
    put(tmp_path, "log.0.jsonl", b"no rotated file\n")
    put(tmp_path, "log.01.jsonl", b"nor this\n")
    want = [
        (2, 0, '{"n":0}'), (2, 8, '{"n":1}\r'), (2, 18, '{"n":2}'),
        (0, 26, '{"n":"é"}'), (0, 37, "last without newline"),
    ]
    assert chain(spark, tmp_path / "log.jsonl") == want
    everything = chain(spark, tmp_path / "log.jsonl", 0)
    assert everything[0] == (11, 0, "too old") and len(everything) == 6
    assert [r[0] for r in chain(spark, tmp_path / "log.jsonl", 1)] == [0, 0]


def test_missing_chain_is_empty(spark, tmp_path):
    assert chain(spark, tmp_path / "none.jsonl") == []
    assert chain(spark, tmp_path / "no-folder" / "none.jsonl") == []


def test_chain_split_over_many_tasks(spark, tmp_path):
    lines = [record(f"line {i} " + "x" * (i % 50)) for i in range(400)]
    put(tmp_path, "a.1.log", "".join(x + "\n" for x in lines[:300]).encode())
    put(tmp_path, "a.log", "".join(x + "\n" for x in lines[300:]).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        frame = read_log_chain(spark, str(tmp_path / "a.log"))
        assert frame.rdd.getNumPartitions() > 5
        got = chain(spark, tmp_path / "a.log")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(400)]
    assert [(p, x) for _, p, x in got] == list(zip(starts, lines))


def test_parse_jsonl(spark):
    rows = spark.createDataFrame(
        [(record("hi", "INFO", pid="7"),), ("{broken",), ("",), ('{"severity": 3}',)], "line string"
    )
    got = parse_jsonl(rows).collect()
    assert [(r.message, r.severity, r.pid, r.app) for r in got] == [
        ("hi", "INFO", "7", None), (None, "3", None, None),
    ]
    assert parse_jsonl(rows, json_only=False).count() == 3


def stored(spark, path):
    rows = [
        (i, s, i // 20, 30 * i, 30, f"line {i}", ("INFO", "ERROR")[i % 9 == 0], bytearray(b"r"))
        for s in ("a", "007") for i in range(200)
    ]
    frame = spark.createDataFrame(
        rows, "seq long, sink string, generation long, pos long, nbytes long, line string, "
        "severity string, raw binary"
    )
    from logweir.schemas import LOG

    full = frame.select(*[
        F.col(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in LOG.fields
    ])
    write_logs(full, path)
    return full


def test_log_table_pages_equal_plain_pages(spark, tmp_path):
    path = f"{tmp_path}/logs"
    full = stored(spark, path).filter("sink = '007'")
    table, flt = LogTable(spark, path, "007"), LogFilter.of(sev="ERR")
    ids = lambda df: [r.seq for r in df.collect()]
    for f in (None, flt):
        assert ids(table.tail(15, f)) == ids(paging.tail(full, 15, f))
        for pos in (0, 1000, 3005, 6000, 9000):
            for since in (-1, 2500):
                assert ids(table.forward(pos, 15, f, since)) == ids(
                    paging.read_forward(full, pos, 15, f, since))
                assert ids(table.backward(pos, 15, f, since)) == ids(
                    paging.read_backward(full, pos, 15, f, since))
    assert ids(table.search("LINE 19", 3)) == [19, 190, 191]
    assert table.search_count("line 19").first()[0] == 11
    assert ids(LogTable(spark, path, "none").tail(5)) == []
    plan = table.between(8, 9)._jdf.queryExecution().executedPlan().toString()
    assert "generation" in plan.split("PartitionFilters")[1].split("]")[0]


def test_expired_segments_are_deleted(spark, tmp_path):
    path = f"{tmp_path}/logs"
    stored(spark, path)
    rules = spark.createDataFrame(
        [("a", "*", True, True, True, None, 2), ("007", "*", True, True, True, None, 0)], ROUTE
    )
    assert drop_expired(spark, path, rules) == 7
    left = {(r.sink, r.generation) for r in read_logs(spark, path).collect()}
    assert left == {("a", g) for g in (7, 8, 9)} | {("007", g) for g in range(10)}
    assert drop_expired(spark, path, rules) == 0


def files(path):
    return {
        os.path.relpath(root, path): sorted(
            line for n in names if n.startswith("part-")
            for line in open(os.path.join(root, n), encoding="utf-8").read().splitlines()
        )
        for root, _, names in os.walk(path) if any(n.startswith("part-") for n in names)
    }


def test_text_and_json_sinks(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "a", 0, bytearray(b"one"), "L1"), (2, "a", 1, bytearray(b"caf\xe9"), "L2"),
         (3, "b", 0, bytearray(b"two"), "L3")],
        "seq long, sink string, generation long, raw binary, line string",
    )
    write_text(rows, f"{tmp_path}/t")
    write_jsonl(rows, f"{tmp_path}/j")
    assert files(f"{tmp_path}/t") == {
        "sink=a/generation=0": ["one"], "sink=a/generation=1": ["caf�"], "sink=b/generation=0": ["two"],
    }
    assert files(f"{tmp_path}/j")["sink=a/generation=1"] == ["L2"]


def test_severity_and_facility_take_the_stored_case(spark):
    rows = parse_jsonl(spark.createDataFrame([('{"severity":"error","facility":"AUTH"}',), ("{broken",), ("[1]",)], "line string"))
    assert [(r.severity, r.facility) for r in rows.collect()] == [("ERROR", "auth")]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from logweir.session import scratch_dir

    settings = {"spark.master": "yarn"}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(SimpleNamespace(conf=SimpleNamespace(get=settings.get)))


def test_segments_expire_by_the_names_of_their_folders(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/logs"
    stored(spark, path)
    for n in (3, 9):  # no file is opened
        folder = tmp_path / "logs" / "sink=a" / f"generation={n}"
        for file in folder.iterdir():
            if file.name.startswith("part-"):
                file.write_bytes(b"no parquet")
    monkeypatch.setattr(sinks, "TASK_SEGMENTS", 2)
    rules = spark.createDataFrame([("a", "*", True, True, True, None, 1)], ROUTE)
    assert drop_expired(spark, path, rules) == 8
    assert sorted(os.listdir(f"{path}/sink=a")) == ["generation=8", "generation=9"]
    assert len(os.listdir(f"{path}/sink=007")) == 10


def test_folders_of_batches_are_found(spark, tmp_path):
    for batch, generation in ((0, 0), (0, 1), (1, 1), (1, 2)):
        for sink in ("a", "b"):
            os.makedirs(f"{tmp_path}/logs/batch={batch}/sink={sink}/generation={generation}")
    got = sinks.segment_folders(spark, f"{tmp_path}/logs")
    assert got.count() == 8
    rules = spark.createDataFrame([("a", "*", True, True, True, None, 1)], ROUTE)
    assert drop_expired(spark, f"{tmp_path}/logs", rules) == 1
    assert os.listdir(f"{tmp_path}/logs/batch=0/sink=a") == ["generation=1"]


def test_stored_segments_come_back(spark, tmp_path, monkeypatch):
    """Odd names of sinks, nulls, several batches of one segment and clustered rows; a failed job leaves nothing."""
    path = f"{tmp_path}/logs"
    full = stored(spark, f"{tmp_path}/other")
    names = ["a/b=c d", "ü%41", "007", None]
    odd = full.withColumn("sink", F.array(*map(F.lit, names))[(F.col("generation") % 4).cast("int")])
    odd = odd.withColumn("generation", F.when(F.col("seq") > 3, F.col("generation"))).withColumn("rcv", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    monkeypatch.setattr(sinks, "GROUP_ROWS", 3)
    wanted = sorted(map(repr, odd.collect()))
    for clustered in (False, True):
        write_logs(odd, path, clustered=clustered)
        assert sorted(map(repr, read_logs(spark, path).collect())) == wanted
    write_logs(odd, path, "append")
    assert sorted(map(repr, read_logs(spark, path).collect())) == sorted(2 * wanted)
    with pytest.raises(Exception):
        write_logs(odd.withColumn("pos", F.raise_error(F.lit("lost")).cast("long")), path)
    assert read_logs(spark, path).count() == 2 * len(wanted)
    assert not [n for n in os.listdir(tmp_path) if "staged" in n]
    write_logs(odd.limit(0), path)
    assert read_logs(spark, path).count() == 0
