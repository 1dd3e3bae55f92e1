import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logweir.functions.labels import facility_label, format_local, format_rcv, severity_label
from logweir.operators import audit
from logweir.operators.audit import Ledger, completeness_report
from logweir.operators.views import detail_view, format_line, grid_view
from logweir.schemas import RECORD

FULL = ("2026-03-12T14:30:22Z", "10.0.0.1", "RFC3164", "auth", "CRITICAL", "box", "su", "12", "ID1",
        "Mar 12 14:30:22", "text")
BARE = ("2026-03-12T14:30:22Z", "10.0.0.1", "UNKNOWN", *[None] * 7, "junk")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([FULL, BARE], RECORD).withColumn("seq", F.monotonically_increasing_id())


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("text, style, want", [
    ("2026-03-12T14:30:22Z", "iso", "2026-03-12T14:30:22Z"),
    ("2026-03-12T14:30:22Z", "time", "14:30:22"),
    ("2026-03-12T14:30:22Z", "short", "03-12 14:30:22"),
    ("2026-03-12T14:30:22+02:00", "other", "03-12 14:30:22"),
    ("not a date", "short", "not a date"), ("2026-13-12T14:30:22Z", "time", "2026-13-12T14:30:22Z"),
    ("", "time", ""),
])
def test_receive_time(spark, text, style, want):
    assert one(spark, text, lambda v: format_rcv(v, style)) == want


def test_labels(spark):
    assert one(spark, None, severity_label) == "UNKNOWN" and one(spark, "info", severity_label) == "INFO"
    assert one(spark, 3, severity_label, "int") == "ERR" and one(spark, 8, severity_label, "int") == "UNKNOWN"
    assert one(spark, None, facility_label) == "unknown" and one(spark, "AUTH", facility_label) == "auth"
    assert one(spark, 15, facility_label, "int") == "clock2" and one(spark, 40, facility_label, "int") == "fac40"


def test_local_time(spark):
    tokyo = lambda v: format_local(v, "Asia/Tokyo")
    assert one(spark, "2026-03-12T20:30:22Z", tokyo) == "2026-03-13 05:30:22"
    assert one(spark, None, tokyo) == ""
    at = datetime.datetime(2026, 3, 12, 20, 30, 22)
    assert one(spark, at, tokyo, "timestamp") == "2026-03-13 05:30:22"


def test_console_lines(rows):
    text = lambda *a: [r.text for r in format_line(rows, *a).collect()]
    assert text() == [
        "[03-12 14:30:22] auth CRITICAL box su [12] text", "[03-12 14:30:22] junk",
    ]
    assert text(("message", "pid", "nope", "msg_time", "src")) == ["text [12] 10.0.0.1", "junk 10.0.0.1"]
    assert text(("rcv",), "time") == ["[14:30:22]", "[14:30:22]"] and text(()) == ["", ""]


def test_empty_pid_vanishes(spark):
    frame = spark.createDataFrame([(*FULL[:7], "", *FULL[8:])], RECORD)
    assert format_line(frame, ("app", "pid", "message")).first().text == "su text"


def test_grid_and_details(rows):
    assert grid_view(rows).collect() == [
        ("Mar 12 14:30:22", "10.0.0.1", "su", "CRITICAL", "text"), ("", "10.0.0.1", "", "UNKNOWN", "junk"),
    ]
    assert len(grid_view(rows, ()).columns) == 10
    details = detail_view(rows.limit(1)).orderBy("ord").collect()
    assert [r.value for r in details] == list(FULL) and details[9].label == "Msg Time"
    assert detail_view(rows).filter("value = '—'").count() == 7


def test_completeness(spark):
    rows = spark.createDataFrame([(x,) for x in [1, 2, 2, 5, 7, 7, 7]], "seq long")
    report = lambda *a: {r.seq: r.copies for r in completeness_report(rows, "seq", *a).collect()}
    assert report() == {2: 2, 3: 0, 4: 0, 6: 0, 7: 3}
    assert report(0, 3) == {0: 0, 2: 2, 3: 0}
    assert completeness_report(rows.filter("false")).collect() == []


def test_ledger_equals_the_report_over_all_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK", 8)
    rng = random.Random(3)
    numbers = [x for x in range(5, 90) if x % 7 and not 30 <= x < 62] * 2 + [3, 3, 3]
    rng.shuffle(numbers)
    batches = [numbers[i::4] for i in range(4)] + [[], [None, 200, 200], [4]]
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.report().collect() == []
    seen = []
    for at, batch in enumerate(batches):
        rows = spark.createDataFrame([(x, "other") for x in batch], "seq long, copies string")
        ledger.add(rows, at)
        ledger.add(rows, at)
        seen += [x for x in batch if x is not None]
        counted = Counter(seen)
        want = {x: counted[x] for x in range(min(seen), max(seen) + 1) if counted[x] != 1}
        got = ledger.report().collect()
        assert {r.seq: r.copies for r in got} == want and len(got) == len(want)
    held, _ = ledger._tables(len(batches) - 1)
    assert all(r.lo // 8 == r.hi // 8 == r.block for r in held.collect())
