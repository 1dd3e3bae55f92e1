import pytest
from pyspark.sql import functions as F

from logweir.functions import fixed
from logweir.operators import joins
from logweir.operators.routing import compile_routes, forward, route, truncate_payload
from logweir.schemas import FORWARD_RULE, ROUTE


def routes(spark, *rows):
    return spark.createDataFrame(
        [(n, spec, bad, True, True, None, 10) for n, spec, bad in rows], ROUTE
    )


def compiled(spark, spec):
    rows = compile_routes(routes(spark, ("s", spec, True))).collect()
    return sorted((r.facility_code is None, r.facility_code) for r in rows)


@pytest.mark.parametrize("spec, codes", [
    ("auth,authpriv", [4, 10]), ("Kernel, KERN ,kern", [0]), ("cron", [9]), ("clock2", [15]),
    ("system,daemon,logaudit,security", [3, 4, 13]), ("\tmail ", [2]), ("local7", [23]),
])
def test_names_to_codes(spark, spec, codes):
    assert compiled(spark, spec) == [(False, c) for c in codes]


@pytest.mark.parametrize("spec", ["*", "", None, "auth,*", " * ,nonsense"])
def test_wildcards(spark, spec):
    assert compiled(spark, spec) == [(True, None)]


@pytest.mark.parametrize("spec, token", [("auth,bogus", "bogus"), ("bogus,*", "bogus"), ("a b", "a b"), (" ", "")])
def test_unknown_names_are_errors(spark, spec, token):
    with pytest.raises(Exception, match=f"Unknown facility name: '{token}'"):
        compiled(spark, spec)


def messages(spark):
    rows = [(i, i, "RFC5424", bytearray(b"x" * i)) for i in range(24)]
    rows += [(100, None, "UNKNOWN", bytearray(b"junk"))]
    return spark.createDataFrame(rows, "seq long, facility_code int, proto string, raw binary") \
        .withColumn("rcv", F.lit(None).cast("timestamp")).withColumn("src", F.lit("s"))


@pytest.mark.parametrize("limit", [100_000, 0])
def test_fan_out(spark, monkeypatch, limit):
    """The same rows whether the rules are broadcast or joined over salts."""
    monkeypatch.setattr(joins.join_small, "__defaults__", ("inner", "seq", limit))
    rules = routes(
        spark, ("main", "*", True), ("clean", "*", False), ("auth", "auth,authpriv", True),
        ("none", "mail", False),
    )
    got = {}
    for row in route(messages(spark), rules).collect():
        got.setdefault(row.sink, []).append(row.seq)
    assert {k: sorted(v) for k, v in got.items()} == {
        "main": [*range(24), 100], "clean": list(range(24)), "auth": [4, 10], "none": [2],
    }


def test_every_code_has_a_name(spark):
    assert sorted(set(fixed.FACILITY_CODES.values())) == list(range(24))


@pytest.mark.parametrize("size, limit, want", [
    (500, 0, b"A" * 500), (10, 10, b"A" * 10), (11, 10, b"A" * 10), (200, 5, b"A" * 5),
    (200, 50, b"A" * 28 + b"[TRUNCATED: 200 bytes]"), (200, 22, b"A" * 22),
    (200, 23, b"A" + b"[TRUNCATED: 200 bytes]"), (0, 3, b""),
])
def test_truncation(spark, size, limit, want):
    row = spark.createDataFrame([(bytearray(b"A" * size),)], "raw binary") \
        .select(truncate_payload(F.col("raw"), limit)).first()
    assert bytes(row[0]) == want


def test_forward_rules(spark):
    rules = spark.createDataFrame(
        [("all", True, "*", 0), ("auth", True, "auth", 2), ("off", False, "*", 0),
         ("usual", True, "local7", None)], FORWARD_RULE,
    )
    got = {}
    for row in forward(messages(spark), rules).collect():
        got.setdefault(row.target, {})[row.seq] = bytes(row.payload)
    assert set(got) == {"all", "auth", "usual"}
    assert set(got["all"]) == {*range(24), 100} and got["all"][100] == b"junk"
    assert got["auth"] == {4: b"xx"} and got["usual"] == {23: b"x" * 23}
