"""Display forms of single fields."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions import fixed

_ISO = r"\A\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?\z"


def format_rcv(rcv: Column, style: str = "short") -> Column:
    """ISO text as ``iso`` (unchanged), ``time`` (HH:MM:SS) or short (MM-DD HH:MM:SS).

    The clock reading is the one written in the text. Text that is no date comes back unchanged.
    """
    if style == "iso":
        return rcv
    clock = F.substring(rcv, 12, 8)
    shown = clock if style == "time" else F.concat_ws(" ", F.substring(rcv, 6, 5), clock)
    stamp = F.concat(F.substring(rcv, 1, 10), F.lit(" "), clock)
    valid = rcv.rlike(_ISO) & stamp.try_cast("timestamp_ntz").isNotNull()
    return F.when(valid, shown).otherwise(rcv)


def _coded(value: Column, table: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in table]), value.try_cast("int"))


def severity_label(value: Column) -> Column:
    """Upper-case name; a stored number is looked up; null or an unknown number is UNKNOWN."""
    text = value.cast("string")
    numeric = text.rlike(r"\A-?[0-9]+\z")
    return F.when(value.isNull(), "UNKNOWN").when(
        numeric, F.coalesce(_coded(text, fixed.SEVERITY_SHORT_NAMES), F.lit("UNKNOWN"))
    ).otherwise(F.upper(text))


def facility_label(value: Column) -> Column:
    """Lower-case name; a stored number is looked up, else ``fac<N>``; null is unknown."""
    text = value.cast("string")
    numeric = text.rlike(r"\A-?[0-9]+\z")
    return F.when(value.isNull(), "unknown").when(
        numeric,
        F.coalesce(_coded(text, fixed.FACILITY_LABELS), F.concat(F.lit("fac"), text)),
    ).otherwise(F.lower(text))


def format_local(rcv: Column, tz: str) -> Column:
    """UTC time (timestamp or ISO text) as ``YYYY-MM-DD HH:MM:SS`` in a zone; null is ''."""
    stamp = F.from_utc_timestamp(F.try_to_timestamp(rcv.cast("string")), tz)
    shown = F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(shown, rcv.cast("string"), F.lit(""))
