"""Row shapes of the stored tables."""

from pyspark.sql import types as T

DATAGRAM = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("rcv", T.TimestampType()),
    T.StructField("src", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])

# A record as JSONL text carries it; every member is text or null.
RECORD = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("rcv", "src", "proto", "facility", "severity", "hostname", "app", "pid", "msgid",
                 "msg_time", "message")
])

ROUTE = T.StructType([
    T.StructField("sink", T.StringType()),
    T.StructField("facility_spec", T.StringType()),
    T.StructField("include_malformed", T.BooleanType()),
    T.StructField("write_text", T.BooleanType()),
    T.StructField("write_jsonl", T.BooleanType()),
    T.StructField("max_bytes", T.LongType()),
    T.StructField("max_files", T.IntegerType()),
])

FORWARD_RULE = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("facility_spec", T.StringType()),
    T.StructField("max_message_size", T.IntegerType()),
])

# A stored log row; the table is partitioned by its last two columns.
LOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("rcv", T.TimestampType()),
    T.StructField("src", T.StringType()),
    T.StructField("raw", T.BinaryType()),
    T.StructField("proto", T.StringType()),
    T.StructField("pri", T.IntegerType()),
    T.StructField("facility_code", T.IntegerType()),
    T.StructField("severity_code", T.IntegerType()),
    T.StructField("version", T.IntegerType()),
    *[
        T.StructField(name, T.StringType())
        for name in ("facility", "severity", "hostname", "app", "pid", "msgid", "msg_time",
                     "message", "line")
    ],
    T.StructField("text_bytes", T.LongType()),
    T.StructField("json_bytes", T.LongType()),
    T.StructField("nbytes", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("sink", T.StringType()),
    T.StructField("generation", T.LongType()),
])

# The rows of one segment in one data file, and where its text and JSONL lines are.
PART = T.StructType([
    T.StructField("generation", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("lines", T.LongType()),
    T.StructField("nbytes", T.LongType()),
    T.StructField("text_bytes", T.LongType()),
    T.StructField("json_bytes", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("jsonl", T.StringType()),
    T.StructField("facets", T.ArrayType(T.StructType([
        T.StructField("facility", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("n", T.LongType()),
    ]))),
])

# A data file of a log store: rows of one sink, sorted by position, and what may be found in it.
FILE = T.StructType([
    T.StructField("sink", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("batch", T.LongType()),
    T.StructField("generation_lo", T.LongType()),
    T.StructField("generation_hi", T.LongType()),
    T.StructField("pos_lo", T.LongType()),
    T.StructField("pos_hi", T.LongType()),
    T.StructField("lines", T.LongType()),
    T.StructField("nbytes", T.LongType()),
    T.StructField("severities", T.ArrayType(T.StringType())),
    T.StructField("facilities", T.ArrayType(T.StringType())),
    T.StructField("grams", T.ArrayType(T.LongType())),
    T.StructField("parts", T.ArrayType(PART)),
])

# What the next batch of a sink goes on from; rows before ``oldest`` are no longer kept.
STATE = T.StructType([
    T.StructField("sink", T.StringType()),
    T.StructField("text_bytes", T.LongType()),
    T.StructField("json_bytes", T.LongType()),
    T.StructField("generation", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("oldest", T.LongType()),
])
