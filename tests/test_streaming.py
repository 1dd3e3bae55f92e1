import datetime
import os

import pytest
from pyspark.sql import functions as F

from logweir.operators import paging
from logweir.operators.parse import parse_syslog
from logweir.operators.segments import retain
from logweir.operators.routing import forward, route
from logweir.schemas import DATAGRAM, FORWARD_RULE, ROUTE
from logweir.sources.datagrams import read_datagrams, stream_datagrams
from logweir.sources.sinks import to_logs
from logweir.sources.store import LogStore
from logweir.streaming.follow import follow, follow_store
from logweir.streaming.outbox import Outbox
from logweir.streaming.ingest import (
    read_ingested, read_segments, segment_batch, start_forward, start_ingest, write_batch,
)

NOW = datetime.datetime(2026, 1, 2, 3, 4, 5)


def land(spark, path, lo, hi):
    rows = [
        (i, NOW, "10.0.0.9", bytearray(
            (f"<{i % 192}>1 t host app {i} - text {i} " + "x" * (i % 40)).encode()
            if i % 11 else b"junk %d" % i
        )) for i in range(lo, hi)
    ]
    spark.createDataFrame(rows, DATAGRAM).coalesce(1).write.mode("append").parquet(path)


def rules(spark, keep=0):
    return spark.createDataFrame([
        ("all", "*", True, True, True, 2_000, keep), ("auth", "auth", False, False, True, 500, keep),
        ("endless", "*", False, True, False, None, 0),
    ], ROUTE)


def key(df):
    return sorted((r.sink, r.seq, r.generation, r.pos, r.line) for r in df.collect())


def test_ingest_in_batches_equals_one_batch(spark, tmp_path):
    """Segments and positions go on across micro-batches and across a restart of the query."""
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    stream = lambda: stream_datagrams(spark, landing, 1)
    land(spark, landing, 0, 60)
    land(spark, landing, 60, 100)
    start_ingest(stream(), rules(spark), out, f"{tmp_path}/c").awaitTermination()
    land(spark, landing, 100, 170)
    start_ingest(stream(), rules(spark), out, f"{tmp_path}/c").awaitTermination()

    flags = rules(spark).select("sink", "write_text", "write_jsonl")
    whole = to_logs(route(parse_syslog(read_datagrams(spark, landing)), rules(spark)).join(flags, "sink"))
    want = key(segment_batch(whole.drop("write_text", "write_jsonl"), rules(spark)))
    got = read_ingested(spark, out)
    assert key(got) == want
    assert {r.batch for r in LogStore(spark, out).files().select("batch").distinct().collect()} == {0, 1, 2}
    assert got.filter("sink = 'all'").agg(F.max("generation")).first()[0] > 5

    # Pages of the ingested log, located by the catalogue.
    logs = read_ingested(spark, out).filter("sink = 'all'")
    table = LogStore(spark, out).sink("all")
    seqs = lambda df: [r.seq for r in df.collect()]
    assert seqs(table.tail(25)) == seqs(paging.tail(logs, 25)) == list(range(145, 170))
    assert seqs(table.forward(3_000, 9)) == seqs(paging.read_forward(logs, 3_000, 9))
    assert seqs(table.backward(9_000, 9)) == seqs(paging.read_backward(logs, 9_000, 9))
    scratch = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert not [f for f in os.listdir(scratch) if f.startswith("scope-")]

    # A batch that runs again changes nothing; one that was lost before its commit is written anew, and
    # what the lost attempt left is not seen.
    before = parts(out)
    write_batch(read_datagrams(spark, landing).filter("seq >= 100"), 2, rules(spark), out)
    assert parts(out) == before
    newest = max(os.listdir(f"{out}/commits"))
    os.rename(f"{out}/commits/{newest}", f"{tmp_path}/lost")
    write_batch(read_datagrams(spark, landing).filter("seq >= 100"), 2, rules(spark), out)
    assert len(parts(out)) > len(before)
    assert key(read_ingested(spark, out)) == want

    lines = follow_store(spark, out).filter("json_bytes > 0")
    shown = collect(spark, follow(lines, None, ["text 1"], ["xxxx"], ("message",)), tmp_path, "f")
    messages = read_ingested(spark, out).filter(
        "json_bytes > 0 AND message LIKE '%text 1%' AND message NOT LIKE '%xxxx%'"
    )
    assert sorted(r.text for r in shown) == sorted(r.message for r in messages.collect())

    tail = read_ingested(spark, out).filter("sink = 'all' AND seq < 100").agg(
        F.max(F.col("pos") + F.col("nbytes"))).first()[0]
    newest = follow_store(spark, out, "all", tail)
    got = collect(spark, follow(newest, columns=("message",)).select("seq", "text"), tmp_path, "g")
    assert sorted(r.seq for r in got) == list(range(100, 170))


def parts(out):
    return sorted(
        os.path.join(root, n) for output in ("data", "jsonl", "text")
        for root, _, names in os.walk(f"{out}/{output}") for n in names
    )


def test_each_sink_is_written_and_expired_as_its_rule_says(spark, tmp_path):
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for lo, hi in ((0, 60), (60, 100), (100, 170)):
        land(spark, landing, lo, hi)
    start_ingest(
        stream_datagrams(spark, landing, 1), rules(spark, 2), out, f"{tmp_path}/c"
    ).awaitTermination()
    rows = read_ingested(spark, out)
    whole = to_logs(route(parse_syslog(read_datagrams(spark, landing)), rules(spark), "write_text", "write_jsonl"))
    want = segment_batch(whole.drop("write_text", "write_jsonl"), rules(spark))
    kept = key(retain(want.filter("sink <> 'endless'"), 2)) + key(want.filter("sink = 'endless'"))
    assert key(rows) == sorted(kept)

    def written(output, column):
        text = LogStore(spark, out).lines(output)
        return sorted((r.sink, r.generation, r.line) for r in text.collect()), sorted(
            (r.sink, r.generation, r[column].decode() if column == "raw" else r[column])
            for r in rows.filter(f"{'text' if column == 'raw' else 'json'}_bytes > 0").collect())

    for output, column, sinks in (("text", "raw", {"all", "endless"}), ("jsonl", "line", {"all", "auth"})):
        got, wanted = written(output, column)
        assert got == wanted and {sink for sink, *_ in got} == sinks
    segments = read_segments(spark, out)
    pairs = lambda df: {(r.sink, r.generation) for r in df.select("sink", "generation").collect()}
    assert pairs(segments) == pairs(rows)
    oldest = rows.filter("sink = 'auth'").agg(F.min("generation")).first()[0]
    followed = follow_store(spark, out, "auth").filter(F.col("generation") >= oldest)
    one = collect(spark, followed.select("line"), tmp_path, "auth")
    assert sorted(r.line for r in one) == sorted(r.line for r in rows.filter("sink = 'auth'").collect())


def collect(spark, stream, tmp_path, name):
    out = f"{tmp_path}/{name}"
    schema = stream.schema
    stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", f"{out}-c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out).collect()


def test_batch_that_reaches_no_sink(spark, tmp_path):
    land(spark, f"{tmp_path}/in", 0, 5)
    only = rules(spark).filter("sink = 'auth'")
    for batch in (0, 1):
        write_batch(read_datagrams(spark, f"{tmp_path}/in").filter("seq < 2"), batch, only, f"{tmp_path}/out")
    assert read_ingested(spark, f"{tmp_path}/out").count() == 0


def test_forwarding_stream_stands_alone(spark, tmp_path):
    landing = f"{tmp_path}/in"
    land(spark, landing, 0, 50)
    land(spark, landing, 50, 80)
    targets = spark.createDataFrame([("x", True, "auth,mail", 20), ("y", True, "*", 0)], FORWARD_RULE)
    start_forward(
        stream_datagrams(spark, landing, 1), targets, f"{tmp_path}/sent", f"{tmp_path}/c"
    ).awaitTermination()
    rows = lambda df: sorted((r.target, r.seq, bytes(r.payload)) for r in df.collect())
    want = forward(parse_syslog(read_datagrams(spark, landing)), targets)
    assert rows(spark.read.parquet(f"{tmp_path}/sent")) == rows(want)


def test_failed_delivery_leaves_ingest_alone(spark, tmp_path):
    landing = f"{tmp_path}/in"
    land(spark, landing, 0, 20)
    bad = spark.createDataFrame([("x", True, "nonsense", 0)], FORWARD_RULE)
    sending = start_forward(stream_datagrams(spark, landing), bad, f"{tmp_path}/s", f"{tmp_path}/c1")
    with pytest.raises(Exception, match="Unknown facility name"):
        sending.awaitTermination()
    start_ingest(
        stream_datagrams(spark, landing), rules(spark), f"{tmp_path}/o", f"{tmp_path}/c2"
    ).awaitTermination()
    assert read_ingested(spark, f"{tmp_path}/o").filter("sink = 'all'").count() == 20


def test_failing_target_stops_no_other(spark, tmp_path):
    """Three targets: one is down for good, one for its first two attempts."""
    landing, out, sent = f"{tmp_path}/in", f"{tmp_path}/out", tmp_path / "sent"
    sent.mkdir()
    land(spark, landing, 0, 30)
    land(spark, landing, 30, 50)
    targets = spark.createDataFrame([(t, True, "*", 0) for t in ("up", "flaky", "down")], FORWARD_RULE)

    def send(target, batches):
        rows = [r for b in batches for r in b.column("seq").to_pylist()]
        tries = len(list(sent.glob(f"{target}-try-*")))
        (sent / f"{target}-try-{tries}").write_text("")
        if target == "down" or target == "flaky" and tries < 2:
            raise ConnectionError("no route to host")
        if rows:
            (sent / f"{target}-{min(rows)}.rows").write_text(",".join(map(str, rows)))

    start_forward(
        stream_datagrams(spark, landing, 1), targets, out, f"{tmp_path}/c", send=send
    ).awaitTermination()
    took = lambda target: sorted(int(x) for f in sent.glob(f"{target}-*.rows") for x in f.read_text().split(","))
    outbox = Outbox(spark, out)
    assert took("up") == list(range(50)) and outbox.progress("up") == {"next": 2, "failed": 0}
    assert outbox.progress("down")["next"] == 0 and outbox.progress("down")["failed"] == 2
    for _ in range(4):
        left = outbox.deliver(["up", "flaky", "down"], send)
    assert took("up") == took("flaky") == list(range(50)) and took("down") == []
    assert sorted(r.seq for r in outbox.dead_letters("down").collect()) == list(range(50)) and left == {}
    assert "no route to host" in outbox.dead_letters("down").first().reason
    assert outbox.dead_letters("up").count() == 0


def test_ingest_without_numbers_counts_arrivals(spark, tmp_path):
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for lo, hi in ((500, 540), (100, 130)):  # arrival order, whatever the rows' own numbers are
        land(spark, landing, lo, hi)
    start_ingest(
        stream_datagrams(spark, landing, 1, numbered=False), rules(spark), out, f"{tmp_path}/c"
    ).awaitTermination()
    rows = read_ingested(spark, out).filter("sink = 'all'").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(70)) and LogStore(spark, out).commit().next_seq == 70
    assert [r.seq for r in sorted(rows, key=lambda r: r.pos)] == list(range(70))
    assert "text 501" in rows[1].line and "text 101" in rows[41].line
