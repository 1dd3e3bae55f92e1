"""The log store: commits, pages and searches that open few files, merging, followers, polls, arrival numbers."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from logweir.functions.predicates import LogFilter
from logweir.operators import paging, search
from logweir.operators.arrival import number_arrivals
from logweir.schemas import LOG
from logweir.sources import files, manifest
from logweir.sources.store import LogStore, write_files
from logweir.streaming.follow import LinePoll, follow_store

WORDS = ["alpha", "Beta", "gamma", "ÉCLAIR", "K-unit", "straße", "delta"]


def rows_of(spark, start, count, sinks=("a", "sink/ü"), per=20, seed=1):
    """Log rows of known positions: 30 and more bytes a line, ``per`` lines a segment."""
    rows = []
    for sink in sinks:
        rng, pos = random.Random(f"{sink}{seed}"), 0
        for i in range(start + count):
            line = f"{sink} line {i} {rng.choice(WORDS)} {'x' * rng.randrange(20)}" + (" NEEDLE-77" if i == 77 else "")
            nbytes = len(line.encode()) + 1
            if i >= start:
                raw = bytearray(f"raw {i}".encode()) + (bytearray(b"\xff!") if i % 13 == 0 else bytearray())
                rows.append((i, sink, i // per, pos, nbytes, line, ("INFO", "ERROR", None)[i % 9 % 3], ("auth", "mail", None)[i % 3],
                             raw, len(raw) + 1 if i % 2 else 0, nbytes if sink == "a" else 0))
            pos += nbytes
    frame = spark.createDataFrame(
        rows, "seq long, sink string, generation long, pos long, nbytes long, line string, severity string, facility string, "
        "raw binary, text_bytes long, json_bytes long")
    known = set(frame.columns)
    return frame.select(*[F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in LOG.fields])


def key(df):
    return sorted((r.sink, r.seq, r.generation, r.pos, r.line) for r in df.collect())


def seqs(df):
    return [r.seq for r in df.collect()]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("store"))
    store = LogStore(spark, out)
    for batch, (start, count) in enumerate(((0, 150), (150, 50), (200, 100))):
        store.append(rows_of(spark, start, count), batch, file_bytes=1_000)
    return store


def test_store_holds_what_was_appended(spark, made):
    assert key(made.rows()) == key(rows_of(spark, 0, 300))
    assert made.commit().version == 2 and made.commit().batch == 2
    found = made.files().collect()
    assert all(r.nbytes <= 1_000 + 60 for r in found) and len(found) > 20
    assert sorted(r.path for r in found) == sorted(
        os.path.relpath(os.path.join(d, n), made.out) for d, _, names in os.walk(f"{made.out}/data") for n in names)


def test_pages_equal_plain_pages_and_open_few_files(spark, made):
    some = LogFilter.of(sev="ERR", fac="mail,auth", inc=["éclair", "k-unit"], exc=["line 1"])
    for sink, flt in (("a", None), ("a", some), ("sink/ü", some)):
        plain, log = rows_of(spark, 0, 300).filter(F.col("sink") == sink), made.sink(sink)
        assert seqs(log.tail(15, flt)) == seqs(paging.tail(plain, 15, flt))
        for pos, since in ((3_005, -1), (3_005, 5_000), (10**9, -1)):
            assert seqs(log.forward(pos, 9, flt, since)) == seqs(paging.read_forward(plain, pos, 9, flt, since))
            assert seqs(log.backward(pos, 9, flt, since)) == seqs(paging.read_backward(plain, pos, 9, flt, since))
    log = made.sink("a")
    assert seqs(log.tail(5)) == list(range(295, 300)) and log.opened == 2
    log.forward(4_000, 5)
    assert log.opened == 2
    assert seqs(made.sink("none").tail(5)) == [] and seqs(log.tail(0)) == []


def test_pages_list_no_folder_of_rows(made, monkeypatch):
    listed = []
    monkeypatch.setattr(files, "names", lambda path, real=files.names: listed.append(path) or real(path))
    made.sink("a").tail(5).collect()
    assert set(listed) == {f"{made.out}/commits"}


def test_search_opens_only_files_that_may_hold_the_needle(spark, made):
    plain, log = rows_of(spark, 0, 300).filter("sink = 'a'"), made.sink("a")
    assert seqs(log.search("needle-77")) == [77] and log.opened == 1
    assert log.search_count("needle-77").first()[0] == 1 and log.opened == 1
    for q in ("éclair", "k-unit", "STRASSE", "straße", "line 12", "ne", "", "missing needle"):
        assert seqs(log.search(q, 25)) == seqs(search.search(plain, q, 25)), q
        assert log.search_count(q).first()[0] == search.search_count(plain, q).first()[0], q
    assert log.search_count("absent from all").first()[0] == 0 and log.opened == 0
    flt = LogFilter.of(inc=["needle-77", "line 299"])
    assert seqs(log.tail(9, flt)) == [77, 299] and log.opened == 2


def test_catalogue_answers_without_log_rows(spark, made, monkeypatch):
    monkeypatch.setattr("logweir.sources.store.read_files", None)
    plain = rows_of(spark, 0, 300)
    want = {(r.sink, r.name): r.n for r in plain.groupBy("sink", F.col("severity").alias("name")).agg(F.count("*").alias("n")).collect()}
    assert {(r.sink, r.name): r.n for r in made.facets("severity").collect()} == want
    labels = search.facet(plain.filter("sink = 'a'"), counts=True)
    assert made.facility_facet("a").collect() == labels.collect()
    sums = {r.sink: (r.kept_bytes, r.kept_lines, r.tail_offset) for r in made.summary().collect()}
    for sink, total in plain.groupBy("sink").agg(F.sum("nbytes")).collect():
        assert sums[sink] == (total, 300, total)
    assert {(r.sink, r.generation, r.lines) for r in made.segments().collect()} == {(s, g, 20) for s in ("a", "sink/ü") for g in range(15)}
    got = made.sink("a").locate([0, 10**9]).orderBy("position").collect()
    assert (got[0].generation, got[0].offset, got[1].generation) == (0, 0, 14)


def test_lines_of_the_text_outputs(spark, made):
    plain = rows_of(spark, 0, 300).collect()
    text = sorted((r.sink, r.generation, bytes(r.raw).replace(b"\xff", "\ufffd".encode()).decode()) for r in plain if r.text_bytes)
    assert sorted(tuple(r) for r in made.lines("text").collect()) == text
    assert sorted(tuple(r) for r in made.lines("jsonl").collect()) == sorted((r.sink, r.generation, r.line) for r in plain if r.json_bytes)


def test_merging_keeps_rows_and_bounds_files(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    for batch in range(6):
        store.append(rows_of(spark, batch * 25, 25), batch, spark.createDataFrame([("a", 4)], "sink string, max_files int"))
    before, pages = key(store.rows()), seqs(store.sink("a").tail(30))
    parts = store.parts().count()
    assert {r.generation for r in store.rows().filter("sink = 'a'").collect()} == {3, 4, 5, 6, 7}
    version = store.commit().version
    assert store.expire(None) > 0 and store.compact() > 2
    assert store.commit().version == version + 1 and store.commit().batch == 5
    assert key(store.rows()) == before and seqs(store.sink("a").tail(30)) == pages
    assert store.files().count() == 2 and store.parts().count() < parts
    segments = store.parts().groupBy("sink", "generation").count()
    assert segments.filter("count > 1").count() == 0  # one part a segment
    assert store.compact() == 0
    lines = sorted(tuple(r) for r in store.lines("jsonl").collect())
    assert store.vacuum(1) > 0
    assert sorted(tuple(r) for r in store.lines("jsonl").collect()) == lines and key(store.rows()) == before
    assert len(manifest.versions(store.out)) == 1
    left = [n for _, _, names in os.walk(f"{store.out}/data") for n in names]
    assert len(left) == 2
    store.append(rows_of(spark, 150, 10), 6)
    assert store.commit().version == version + 2 and seqs(store.sink("a").tail(3)) == [157, 158, 159]


def test_expired_segments_go_with_their_lines(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    limits = spark.createDataFrame([("a", 2), ("b", 0)], "sink string, max_files int")
    at = None
    for batch in range(4):
        done = store.append(rows_of(spark, batch * 40, 40, ("a", "b")), batch, limits)
        store.expire(at)
        at = done
    kept = {(r.sink, r.generation) for r in store.rows().select("sink", "generation").distinct().collect()}
    assert kept == {("a", g) for g in (5, 6, 7)} | {("b", g) for g in range(8)}
    names = sorted(int(n.split("-")[0]) for n in os.listdir(f"{store.out}/text/a"))
    assert set(names) == {5, 6, 7} and len(os.listdir(f"{store.out}/data/a")) == 2
    assert {r.sink: r.kept_lines for r in store.summary().collect()} == {"a": 60, "b": 160}
    assert store.expire(at) == 0


def test_what_is_not_committed_is_not_there(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    assert store.commit() is None and store.rows().count() == 0 and store.files().count() == 0 and store.compact() == 0
    assert seqs(store.sink("a").tail(5)) == []
    write_files(rows_of(spark, 0, 10), store.out, 0).collect()  # an attempt that was lost before its commit
    assert store.rows().count() == 0
    store.append(rows_of(spark, 0, 10), 0)
    assert store.rows().count() == 20
    with pytest.raises(FileExistsError):
        manifest.commit(store.out, store.commit())
    store.append(rows_of(spark, 10, 0), 1)  # a batch without rows
    assert store.rows().count() == 20 and store.commit().batch == 1


def shown(spark, stream, path):
    stream.writeStream.format("parquet").option("path", f"{path}/o").option("checkpointLocation", f"{path}/c").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/o")


def test_followers_see_every_row_once(spark, tmp_path):
    store = LogStore(spark, f"{tmp_path}/s")
    store.append(rows_of(spark, 0, 30), 0)
    follow = lambda: shown(spark, follow_store(spark, store.out, "a", 300, 1).select("seq", "pos"), f"{tmp_path}/f")
    first = follow().count()
    write_files(rows_of(spark, 0, 30), store.out, 1).collect()
    store.append(rows_of(spark, 30, 30), 1)
    store.compact()
    rows = follow()
    want = rows_of(spark, 0, 60).filter("sink = 'a' AND pos >= 300")
    assert 0 < first < rows.count()
    assert sorted((r.seq, r.pos) for r in rows.collect()) == sorted((r.seq, r.pos) for r in want.collect())


def test_polls_go_on_inside_a_file(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    poll = LinePoll(store, "a", "console")
    assert seqs(poll.poll(7)) == []
    store.append(rows_of(spark, 0, 20), 0)
    assert seqs(poll.poll(7)) == list(range(7))
    assert seqs(LinePoll(store, "a", "console").poll(7)) == list(range(7, 14))  # another reader with the same cursor
    assert seqs(poll.poll(7)) == list(range(14, 20))
    assert seqs(poll.poll(7)) == []
    store.append(rows_of(spark, 20, 10), 1)
    store.compact()
    assert seqs(poll.poll(200)) == list(range(20, 30)) and seqs(poll.poll(200)) == []
    errors = LinePoll(store, "a", "errors", LogFilter.of(sev="error"))
    assert seqs(errors.poll(3)) == [1, 4, 7] and errors.position() < poll.position()


@pytest.mark.parametrize("flt, want", [(None, list(range(30))), (LogFilter.of(sev="error"), list(range(1, 30, 3)))])
def test_full_polls_are_the_polls_one_by_one(spark, tmp_path, flt, want):
    store = LogStore(spark, str(tmp_path))
    assert LinePoll(store, "a", "none", flt).full_polls(7)[1] == 0
    store.append(rows_of(spark, 0, 20), 0)
    store.append(rows_of(spark, 20, 10), 1)
    one, many = LinePoll(store, "a", "one", flt), LinePoll(store, "a", "many", flt)
    rows, full = many.full_polls(7, ("seq",))
    assert full == len(want) // 7
    for number in range(full):
        page = seqs(one.poll(7))
        assert page == want[7 * number:7 * number + 7] == sorted(r.seq for r in rows.where(F.col("poll") == number).collect())
    assert rows.count() == 7 * full and many.position() == one.position()
    assert seqs(many.poll(7)) == want[7 * full:] == seqs(one.poll(7))
    rows, full = many.full_polls(7)
    assert full == 0 and rows.count() == 0


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_lines_are_read_some_at_a_time(tmp_path, size):
    want = ["", "é", "a\rb", "x" * 40, "", "end"]
    (tmp_path / "f").write_bytes("".join(line + "\n" for line in want).encode())
    read = list(files.lines(str(tmp_path / "f"), size))
    assert [line for some in read for line in some] == want and (size > 1 or len(read) == len(want))
    (tmp_path / "none").write_bytes(b"")
    assert list(files.lines(str(tmp_path / "none"), size)) == []


def test_many_small_files_are_read_and_deleted_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("logweir.sources.store.TASK_FILES", 1)
    store = LogStore(spark, str(tmp_path))
    at = store.append(rows_of(spark, 0, 80), 0)
    read = store.lines("jsonl")
    assert read.rdd.getNumPartitions() > 3 and read.count() == store.rows().where("json_bytes > 0").count()
    limits = spark.createDataFrame([("a", 1), ("b", 1)], "sink string, max_files int")
    store.append(rows_of(spark, 80, 40), 1, limits)
    assert store.expire(at) > 0 and store.lines("jsonl").count() == store.rows().where("json_bytes > 0").count()


def test_rows_in_runs_are_written_as_they_lie(spark, tmp_path):
    rows = rows_of(spark, 0, 40).coalesce(1)
    files = write_files(rows, str(tmp_path), 0, clustered=True)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    store = LogStore(spark, f"{tmp_path}/s")
    store.append(rows.orderBy(F.desc("seq")), 0, clustered=True)  # no run at all: more files, the same rows
    assert seqs(store.sink("a").forward(0, 100)) == list(range(40)) and seqs(store.sink("a").tail(3)) == [37, 38, 39]


def test_arrival_numbers_are_dense_and_repeatable(spark):
    time = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    rows = [(f"f{f}", time(t), i) for f, t, n in ((2, 1, 3), (0, 2, 4), (1, 2, 2)) for i in range(n)]
    frame = spark.createDataFrame(rows, "file_name string, file_time timestamp, row_index long")
    for parts in (1, 5):
        numbered, after = number_arrivals(frame.withColumn("payload", F.concat("file_name", "row_index")).repartition(parts), 100)
        assert after == 109 and numbered.columns == ["payload", "seq"]
        got = [r.payload for r in numbered.orderBy("seq").collect()]
        assert got == ["f20", "f21", "f22", "f00", "f01", "f02", "f03", "f10", "f11"]
        assert sorted(r.seq for r in numbered.collect()) == list(range(100, 109))
    assert number_arrivals(frame.limit(0), 7)[1] == 7
    own = spark.createDataFrame([(5,)], "seq long")
    assert number_arrivals(own, 7) == (own, 7)

