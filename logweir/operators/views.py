"""Console lines, grid rows and one-record details."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import fixed
from logweir.functions.labels import format_local, format_rcv, severity_label
from logweir.functions.text import rcv_iso


def _rcv_text(rows: DataFrame) -> Column:
    """Receive time as ISO text, whether stored as a timestamp or as text."""
    rcv = F.col("rcv")
    return rcv if dict(rows.dtypes)["rcv"] == "string" else rcv_iso(rcv)


def format_line(
    rows: DataFrame, columns: tuple[str, ...] = fixed.LINE_COLUMNS, style: str = "short",
    output: str = "text",
) -> DataFrame:
    """Add the chosen columns in order, joined by a space; nulls and unknown columns vanish."""
    def part(name: str) -> Column | None:
        if name == "rcv":
            return F.concat(F.lit("["), format_rcv(_rcv_text(rows), style), F.lit("]"))
        if name == "pid":
            return F.when(F.col("pid") != "", F.concat(F.lit("["), F.col("pid"), F.lit("]")))
        if name in fixed.RECORD_FIELDS and name != "msg_time":
            return F.col(name)
        return None

    parts = [p for p in map(part, columns) if p is not None]
    return rows.withColumn(output, F.concat_ws(" ", *parts) if parts else F.lit(""))


def grid_view(
    rows: DataFrame, hidden: tuple[str, ...] = fixed.GRID_HIDDEN, tz: str = "UTC",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The ten grid columns less the hidden ones; nulls are empty, ``keep`` passes columns on."""
    shown = {
        "time": F.col("msg_time"), "rcv": format_local(_rcv_text(rows), tz),
        "sev": severity_label(F.col("severity")),
    }
    cells = [
        F.coalesce(shown.get(name, F.col(name)), F.lit("")).alias(name)
        for name in fixed.GRID_COLUMNS if name not in hidden
    ]
    return rows.select(*keep, *cells)


def detail_view(rows: DataFrame, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Each record as 11 (ord, label, value) rows in fixed order; a null shows as a dash."""
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("ord"), F.lit(label).alias("label"),
            F.coalesce(_rcv_text(rows) if name == "rcv" else F.col(name), F.lit("—")).alias("value"),
        )
        for i, (name, label) in enumerate(fixed.DETAIL_LABELS)
    ])
    return rows.select(*keep, F.inline(cells))
