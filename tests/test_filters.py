import pytest
from pyspark.sql import functions as F

from logweir.functions.predicates import (
    LogFilter, all_of, clean, drop_bad_lines, facility_matches, line_field, message_filter,
    severity_hidden, since,
)
from logweir.sources.chain import parse_jsonl
from model import record


def kept(spark, lines, flt: LogFilter):
    """Indexes accepted on columns and on raw text, which must agree."""
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    by_text = {r.i for r in rows.filter(flt.line_condition()).collect()}
    by_column = {
        r.i for r in parse_jsonl(rows).filter(flt.condition(canonical=False)).collect()
    }
    assert by_text == by_column
    return by_text


@pytest.mark.parametrize("flt, want", [
    (LogFilter.of(), {0, 1, 2, 3}),
    (LogFilter.of(inc=["FAIL", "login"]), {0, 1}),
    (LogFilter.of(exc=["fail"]), {1, 2, 3}),
    (LogFilter.of(inc=["disk"], exc=["failed"]), {3}),
    (LogFilter.of(sev="error"), {0}),
    (LogFilter.of(sev=" Err , info,,"), {0, 1}),
    (LogFilter.of(fac="AUTH,cron"), {1}),
    (LogFilter.of(sev="info", fac="daemon"), set()),
    (LogFilter.of(inc=["  "], exc=[""]), {0, 1, 2, 3}),
    (LogFilter.of(inc=["severity"]), {0, 1, 2, 3}),
])
def test_log_filter(spark, flt, want):
    lines = [
        record("Disk FAILED", "ERROR"), record("user login", "INFO", "auth"),
        record("info only", None, None), record("disk ok", "WARNING", "mail"),
    ]
    assert kept(spark, lines, flt) == want


def test_field_from_raw_text(spark):
    lines = [
        '{"severity": \t"Info","x":1}', '{"severity":null}', '{"severity":3}', '{"message":"hi"}',
        '{"severity":"open', '{"a":1, "severity":"A","o":{"severity":"B"}}', "",
    ]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0] for r in rows.select(line_field(F.col("line"), "severity")).collect()]
    assert got == ["info", None, None, None, None, "a", None]


def test_message_filter_looks_at_the_message_alone(spark):
    rows = spark.createDataFrame(
        [(0, "Hello World", "x"), (1, None, "hello"), (2, "other", "hello")],
        "i int, message string, app string",
    )
    ids = lambda c: {r.i for r in rows.filter(c).collect()}
    assert ids(message_filter(["HELLO"])) == {0}
    assert ids(message_filter([], ["hello"])) == {1, 2}
    assert ids(message_filter()) == {0, 1, 2}
    assert ids(message_filter(["hello", "other"], ["world"])) == {2}


def test_hidden_levels_and_codes(spark):
    rows = spark.createDataFrame(
        [("EMERGENCY", 0), ("ERROR", 4), ("INFO", 15), (None, None)],
        "severity string, facility_code int",
    )
    names = lambda c: [r.severity for r in rows.filter(c).collect()]
    assert severity_hidden([]) is None
    assert names(severity_hidden(["emerg", "INFO"])) == ["ERROR"]
    assert names(severity_hidden(["err"])) == ["EMERGENCY", "INFO"]
    assert names(facility_matches([])) == ["EMERGENCY", "ERROR", "INFO", None]
    assert names(facility_matches([4, 15])) == ["ERROR", "INFO"]
    assert since(-1) is None and names(all_of()) == ["EMERGENCY", "ERROR", "INFO", None]
    assert clean([" A", "", "a", "b "]) == ["a", "b"]


def test_bad_lines(spark):
    rows = spark.createDataFrame(
        [(x,) for x in ['{"a":1}', "", "{bad", "[1]", '"s"', "7", ' {"b":null} ']], "line string"
    )
    lines = lambda c: [r.line for r in rows.filter(c).collect()]
    assert len(lines(drop_bad_lines())) == 6
    assert lines(drop_bad_lines(json_only=True)) == ['{"a":1}', ' {"b":null} ']


def test_stored_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("INFO", "kern", "x")], "severity string, facility string, line string") \
        .write.parquet(f"{tmp_path}/t")
    flt = LogFilter.of(sev="err", fac="auth", inc=["x"])
    plan = spark.read.parquet(f"{tmp_path}/t").filter(flt.condition())._jdf.queryExecution() \
        .executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "In(severity, [ERR,ERROR])" in pushed and "IsNotNull(facility)" in pushed
