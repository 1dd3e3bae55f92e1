"""Datagrams to typed records: RFC 5424, RFC 3164 or UNKNOWN, never failing.

``parse_syslog`` is a chain of plain projections. Each step names the values the next one uses more
than once, so Catalyst keeps the steps apart and nothing is evaluated twice.

The record leaves the chain through ``inline``, as the one row a table function yields per datagram.
A filter on parsed fields therefore runs on the finished record; without that, Catalyst would copy
the whole chain into the filter once per use. Columns a query does not need are left out by naming
the wanted ones.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import fixed
from logweir.functions.text import (
    byte_view, is_utf8, nilable, rcv_iso, repair_view, strip_eol, view_bytes,
)

PARSED_COLUMNS = (
    "seq", "rcv", "src", "raw", "proto", "pri", "facility_code", "severity_code", "version",
    "facility", "severity", "hostname", "app", "pid", "msgid", "msg_time", "message",
)

# Month, day 1-31 and HH:MM:SS with any run of spaces in between.
_LEGACY_TIME = (
    r"\A(?:" + "|".join(fixed.MONTHS) + r") +(?:0?[1-9]|[12][0-9]|3[01]) +"
    r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
)


def _after(text: str, position: Column) -> Column:
    return F.substring(F.col(text), position + 1, F.lit(2**31 - 1))


def _before(text: str, position: Column) -> Column:
    return F.substring(F.col(text), F.lit(1), position - 1)


def _new_method(df: DataFrame) -> DataFrame:
    """The same rows, as the start of a new compiled method.

    One fused method above 8,000 bytes of bytecode is never compiled by the JVM; the table function
    ends one and begins the next without leaving the stage.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _name(names: tuple[str, ...], code: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), code)


def with_pri(df: DataFrame, view: str) -> DataFrame:
    """Add ``pri``: the value 0-191 of ``<NNN>`` at the start of text column ``view``, else null."""
    digits = F.regexp_extract(F.substring(view, 1, 5), r"\A<([0-9]{1,3})>", 1)
    value = F.when(F.col("_digits") != "", F.col("_digits").cast("int"))
    staged = df.withColumn("_digits", digits).withColumn("_value", value)
    pri = F.when(F.col("_value") <= fixed.MAX_PRI, F.col("_value"))
    return staged.withColumn("pri", pri).drop("_digits", "_value")


def parse_syslog(datagrams: DataFrame, columns: Iterable[str] = PARSED_COLUMNS) -> DataFrame:
    """(seq, rcv, src, payload) rows to records with the wanted ``columns``."""
    c = F.col
    flagged = datagrams.select("seq", "rcv", "src", "payload", is_utf8(c("payload")).alias("_ok"))
    # Header delimiters are ASCII and a damaged sequence never spans one, so repairing the whole
    # payload first gives the same fields as repairing each field.
    viewed = flagged.withColumn(
        "_view",
        strip_eol(
            F.when(c("_ok"), c("payload").cast("string"))
            .otherwise(repair_view(byte_view(c("payload"))))
        ),
    )
    # The exact bytes differ from the text only where something was repaired.
    raw = F.when(c("_ok"), c("_view").cast("binary")).otherwise(
        view_bytes(strip_eol(byte_view(c("payload"))))
    )
    body = F.when(c("pri").isNotNull(), _after("_view", F.instr("_view", ">")))
    split = with_pri(viewed.withColumn("raw", raw).drop("payload", "_ok"), "_view").withColumn(
        "_body", body
    ).select(
        "*",
        F.when(c("_body").rlike(r"\A0?1 "), F.split("_body", " ", 7)).alias("_tok"),
        F.when(
            F.substring("_body", 1, 3).isin(*fixed.MONTHS),
            F.regexp_extract("_body", _LEGACY_TIME, 0),
        ).alias("_time"),
    )
    chosen = _new_method(split).withColumn(
        "proto",
        F.when(F.size("_tok") >= 6, F.lit("RFC5424"))
        .when(c("_time") != "", F.lit("RFC3164"))
        .otherwise(F.lit("UNKNOWN")),
    )
    is5, is3 = c("proto") == "RFC5424", c("proto") == "RFC3164"

    # RFC 3164 after the time: one optional space, host up to a space, tag up to a colon (or one
    # word without any), one optional space, text.
    hosted = chosen.withColumn(
        "_rest", F.when(is3, _after("_body", F.length("_time")))
    ).withColumn(
        "_host", F.split(F.when(c("_rest").startswith(" "), _after("_rest", F.lit(1)))
                         .otherwise(c("_rest")), " ", 2)
    ).withColumn(
        "_tagged", F.coalesce(F.get("_host", F.lit(1)), F.lit(""))
    ).withColumn(
        "_colon", F.instr("_tagged", ":")
    ).withColumn(
        "_end", F.when(c("_colon") > 0, c("_colon")).otherwise(F.instr(F.concat("_tagged", F.lit(" ")), " "))
    ).withColumn(
        "_tag", _before("_tagged", c("_end"))
    ).withColumn(
        "_text", _after("_tagged", c("_end"))
    ).withColumn(
        "_open", F.when(c("_tag").endswith("]"), F.instr("_tag", "[")).otherwise(F.lit(0))
    ).withColumn(
        "_app", F.when(c("_open") > 0, _before("_tag", c("_open"))).otherwise(F.rtrim("_tag"))
    ).withColumn(
        "_pid", F.when(c("_open") > 0, F.substring(c("_tag"), c("_open") + 1, F.length("_tag") - c("_open") - 1))
    )

    token = [F.get("_tok", F.lit(i)) for i in range(7)]
    # A fifth token that is empty because the input ends there is absent, not empty.
    msgid = F.when((F.size("_tok") > 6) | (token[5] != ""), nilable(token[5]))
    text = F.when((c("_colon") > 0) & c("_text").startswith(" "), _after("_text", F.lit(1)))
    host3 = F.get("_host", F.lit(0))
    fields = hosted.select(
        "seq", "rcv", "src", "raw", "proto",
        F.when(c("proto") != "UNKNOWN", c("pri")).alias("pri"),
        F.when(is5, F.lit(1)).alias("version"),
        F.when(is5, nilable(token[2]))
        .when((host3 != "") | (F.size("_host") > 1), host3).alias("hostname"),
        F.when(is5, nilable(token[3])).when(c("_app") != "", c("_app")).alias("app"),
        F.when(is5, nilable(token[4])).when(c("_pid") != "", c("_pid")).alias("pid"),
        F.when(is5, msgid).alias("msgid"),
        F.when(is5, nilable(token[1])).when(is3, c("_time")).alias("msg_time"),
        F.when(is5, F.coalesce(token[6], F.lit("")))
        .when(is3, F.coalesce(text, c("_text"))).otherwise(c("_view")).alias("message"),
    )
    coded = fields.select(
        "*",
        F.shiftright("pri", 3).alias("facility_code"),
        F.col("pri").bitwiseAND(7).alias("severity_code"),
    )
    named = coded.select(
        "*",
        _name(fixed.FACILITY_NAMES, c("facility_code")).alias("facility"),
        _name(fixed.SEVERITY_NAMES, c("severity_code")).alias("severity"),
    )
    record = F.struct(*[c(name) for name in columns])
    return named.select(F.inline(F.array(record)))


def jsonl_line(rcv: Column | None = None) -> Column:
    """The record as one JSON object: 11 keys in fixed order, nulls written out."""
    rcv = rcv_iso(F.col("rcv")) if rcv is None else rcv
    members = [rcv.alias("rcv")] + [F.col(f) for f in fixed.RECORD_FIELDS[1:]]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})


def to_jsonl(parsed: DataFrame) -> DataFrame:
    """Parsed rows plus ``line``, their JSONL text, built once however often it is filtered on."""
    return parsed.select("*", F.inline(F.array(F.struct(jsonl_line().alias("line")))))
