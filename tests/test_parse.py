import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

import model
from logweir.functions import fixed
from logweir.functions.text import is_utf8, sanitize_utf8
from logweir.operators.parse import parse_syslog, to_jsonl
from logweir.schemas import DATAGRAM

NOW = datetime.datetime(2026, 3, 4, 5, 6, 7, 890000)
FIELDS = ("proto", "pri", "version", "hostname", "app", "pid", "msgid", "msg_time", "message")


def run(spark, payloads):
    rows = [(i, NOW, "10.1.2.3", bytearray(p)) for i, p in enumerate(payloads)]
    return to_jsonl(parse_syslog(spark.createDataFrame(rows, DATAGRAM))).orderBy("seq").collect()


HAND_PICKED = [
    b"<34>1 2026-03-12T14:30:22Z box su 123 ID47 - some text",
    b"<13>1 - - - - - - all nil",
    b"<165>01 t h a - - [sd k=\"v\"] body",
    b"<34>2 t h a - - text", b"<34>001 t h a - - text", b"<34>1  h a - - text",
    b"<0>1 t h a p m x", b"<191>1 t h a p m x", b"<192>1 t h a p m x", b"<007>1 t h a p m x",
    b"<0007>1 t h a p m x", b"<>1 t h a p m x", b"< 7>1 t h a p m x", b"<+7>1 t h a p m x",
    b"<34>1 t", b"<34>1 a b c d", b"<34>1 a b c d ", b"<34>1 a b c d e", b"<34>1 a b c d e ",
    b"<34>1 a b c d -", b"<34>1     ", b"<34>1    ", b"<34>1 t h a p m two\r\nlines\r\n\r\n",
    b"<34>1 t h a p m \n", b"<34>1 t h a p m tail \r", b"<34>1 t h a p m \xe2\x80\xa8 sep",
    b"<34>Jan 12 15:04:05 box su[123]: text", b"<34>Jan  5 09:00:00 box app: body",
    b"<34>Jan    05     09:00:00 box app: body", b"<34>Jan 5 09:00:00box app: body",
    b"<34>Jan 5 09:00:00  app: body", b"<34>Jan 5 09:00:00", b"<34>Jan 5 09:00:00 ",
    b"<34>Jan 5 09:00:00 box", b"<34>Jan 5 09:00:00 box ", b"<34>Jan 5 09:00:00 box  lead",
    b"<13>Feb 28 10:20:30 box app rest of it", b"<13>Feb 28 10:20:30 box a b c: d: e",
    b"<13>Feb 28 10:20:30 box app :  text", b"<13>Feb 28 10:20:30 box [12]: text",
    b"<13>Feb 28 10:20:30 box app[]: text", b"<13>Feb 28 10:20:30 box app[1][2]: text",
    b"<13>Feb 28 10:20:30 box app[1] : text", b"<13>Feb 28 10:20:30 box app]: text",
    b"<13>Feb 28 10:20:30 box :text", b"<13>Feb 28 10:20:30 box app[7]",
    b"<13>Feb 28 10:20:30 box app[7] text", b"<13>Feb 28 10:20:30 box \n: x",
    b"<13>Xyz 28 10:20:30 box a: b", b"<13>jan 28 10:20:30 box a: b", b"<13>Jan28 10:20:30 b a: b",
    b"<13>Jan 0 10:20:30 b a: b", b"<13>Jan 32 10:20:30 b a: b", b"<13>Jan 123 10:20:30 b a: b",
    b"<13>Jan 00 10:20:30 b a: b", b"<13>Jan 3 24:20:30 b a: b", b"<13>Jan 3 10:60:30 b a: b",
    b"<13>Jan 3 10:20:60 b a: b", b"<13>Jan 3 1:20:30 b a: b", b"<13>Jan 3 10:20:3",
    b"", b"hello", b"<13>", b"\r\n", b"<13 no close", b"\xff" * 64, b"<13>\x00\x01\x02",
    b"<13>1 t host\xffname app p m caf\xe9", b"<13>Mar 1 01:02:03 h\xe2\x82 a\xf0\x9f: \xe2\x82",
    b"<13>1 t h a p m " + b"x" * 65000, b"<13>1 t h a p m " + "é€😀".encode() * 6000,
    b"\xc3\xa9\r\n\xe9\r\n",
]


def random_payloads(n, seed):
    rng = random.Random(seed)
    pieces = [
        b"<34>", b"<191>", b"<0>", b"<192>", b"1 ", b"01 ", b"2 ", b" ", b"  ", b"-", b"- ", b":",
        b"[", b"]", b"[12]", b"Jan 12 15:04:05", b"Feb  3 00:00:00 ", b"host ", b"app", b"\n",
        b"\r\n", b"\xc3\xa9", b"\xe2\x82", b"\xff", b"\x80", b"text", b": ", b"\x00", b"\t",
    ]
    starts = [b"<34>1 ", b"<13>Jan  2 03:04:05 ", b"<7>", b""]
    return [
        rng.choice(starts) + b"".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        for _ in range(n)
    ]


def test_parser_equals_model(spark):
    payloads = HAND_PICKED + random_payloads(4000, 11)
    protos = set()
    for payload, row in zip(payloads, run(spark, payloads)):
        want = model.parse(payload)
        assert {f: row[f] for f in FIELDS} == {f: want[f] for f in FIELDS}, payload[:200]
        assert bytes(row.raw) == want["raw"], payload[:200]
        pri = want["pri"]
        assert row.facility == (None if pri is None else fixed.FACILITY_NAMES[pri // 8])
        assert row.severity == (None if pri is None else fixed.SEVERITY_NAMES[pri % 8])
        assert (row.facility is None) == (row.severity is None)
        assert row.raw or not payload.rstrip(b"\r\n")
        protos.add(row.proto)
        got = json.loads(row.line)
        assert tuple(got) == fixed.RECORD_FIELDS
        assert got["rcv"] == "2026-03-04T05:06:07Z" and got["src"] == "10.1.2.3"
        assert got["message"] == want["message"]
    assert protos == {"RFC5424", "RFC3164", "UNKNOWN"}


def test_wanted_columns_only(spark):
    frame = spark.createDataFrame([(1, NOW, "s", bytearray(HAND_PICKED[0]))], DATAGRAM)
    assert parse_syslog(frame, ("proto", "app")).collect() == [("RFC5424", "su")]


def test_utf8_repair_is_one_mark_per_bad_byte(spark):
    rng = random.Random(5)
    edges = [0x00, 0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0,
             0xE1, 0xEC, 0xED, 0xEE, 0xEF, 0xF0, 0xF1, 0xF3, 0xF4, 0xF5, 0xFF]
    data = [bytes(rng.choice(edges) for _ in range(rng.randrange(12))) for _ in range(4000)]
    data += [c.encode() for c in "é߿ࠀ퟿￿𐀀􏿿"] + [b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe2\x82"]
    frame = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary")
    rows = frame.select("i", sanitize_utf8(F.col("d")).alias("s"), is_utf8(F.col("d")).alias("ok"))
    for row in rows.orderBy("i").collect():
        want = model.repair(data[row.i])
        assert row.s == want, data[row.i]
        assert row.ok == (want.encode() == data[row.i])


@pytest.mark.parametrize("wanted", ["severity", "app", "line"])
def test_filter_runs_after_the_parse(spark, wanted):
    """A filter on parsed columns must not copy the parse chain: one split in the whole plan."""
    frame = spark.createDataFrame([(1, NOW, "s", bytearray(b"x"))], DATAGRAM).repartition(2)
    parsed = to_jsonl(parse_syslog(frame)).filter(F.col(wanted).contains("x"))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_LEGACY_TIME") == 0 and plan.count("regexp_extract(_body") == 1
