"""Pages of one log by byte position. Input rows carry ``pos``, ``nbytes`` and ``line``."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import fixed
from logweir.functions.predicates import LogFilter, NO_FILTER, all_of, since as from_position
from logweir.operators.positions import log_summary


def _condition(flt: LogFilter | Column | None) -> Column:
    flt = NO_FILTER if flt is None else flt
    return flt.condition() if isinstance(flt, LogFilter) else flt


def _first(rows: DataFrame, count: int, newest: bool = False) -> DataFrame:
    if count <= 0:
        return rows.limit(0)
    if not newest:
        return rows.orderBy("pos").limit(count)
    return rows.orderBy(F.desc("pos")).limit(count).orderBy("pos")


def read_forward(
    logs: DataFrame, pos: int, count: int, flt: LogFilter | Column | None = None, since: int = -1
) -> DataFrame:
    """The first ``count`` matching lines starting at or after ``pos`` and ``since``."""
    return _first(logs.filter((F.col("pos") >= max(pos, since)) & _condition(flt)), count)


def read_backward(
    logs: DataFrame, pos: int, count: int, flt: LogFilter | Column | None = None, since: int = -1
) -> DataFrame:
    """The last ``count`` matching lines starting before ``pos``, oldest first."""
    kept = all_of(F.col("pos") < pos, from_position(since), _condition(flt))
    return _first(logs.filter(kept), count, newest=True)


def tail(
    logs: DataFrame, n: int = fixed.PAGE_LINES, flt: LogFilter | Column | None = None,
    since: int = -1,
) -> DataFrame:
    """The last ``n`` matching lines, oldest first."""
    return _first(logs.filter(all_of(from_position(since), _condition(flt))), n, newest=True)


def show_all(logs: DataFrame, flt: LogFilter | Column | None = None) -> DataFrame:
    """Every matching line, oldest first."""
    return logs.filter(_condition(flt)).orderBy("pos")


def context_window(
    logs: DataFrame, pos: int, count: int = fixed.PAGE_LINES,
    flt: LogFilter | Column | None = None,
) -> DataFrame:
    """The page that starts at a search hit."""
    return read_forward(logs, pos, count, flt)


def latest_rows(rows: DataFrame, cap: int = fixed.LIVE_ROWS) -> DataFrame:
    """The newest ``cap`` rows of a result, oldest first."""
    return _first(rows, cap, newest=True)


def _page_row(logs: DataFrame, page: DataFrame, since: int) -> tuple[DataFrame, Column]:
    summary = page.agg(
        F.count("*").alias("lines"), F.min("pos").alias("_first"),
        F.max(F.col("pos") + F.col("nbytes")).alias("_end"),
    )
    total = log_summary(logs).select("total").scalar()
    with_total = summary.select("*", total.alias("total"))
    nothing = F.col("total") == 0
    return with_total, (nothing | (F.lit(since) >= F.col("total"))) if since >= 0 else nothing


def _columns(first: Column, following: Column) -> list[Column]:
    return [
        F.col("lines"), first.cast("long").alias("first_offset"),
        following.cast("long").alias("next_offset"), F.col("total"),
        F.col("total").alias("tail_offset"),
    ]


def forward_summary(
    logs: DataFrame, pos: int, count: int, flt: LogFilter | Column | None = None, since: int = -1
) -> DataFrame:
    """One row about a forward page: lines, first and next offset, total, tail offset.

    A full page continues after its last line, a short one at the end of the log; without any match
    the position stays where it was.
    """
    start = max(pos, since)
    row, nothing = _page_row(logs, read_forward(logs, pos, count, flt, since), since)
    empty = F.col("lines") == 0
    first = F.when(nothing, 0).when(empty, start).otherwise(F.col("_first"))
    following = (
        F.when(nothing, 0).when(empty, start)
        .when(F.col("lines") == count, F.col("_end")).otherwise(F.col("total"))
    )
    return row.select(*_columns(first, following))


def backward_summary(
    logs: DataFrame, pos: int | None, count: int, flt: LogFilter | Column | None = None,
    since: int = -1,
) -> DataFrame:
    """One row about a backward page; ``pos`` None is the end of the log."""
    page = tail(logs, count, flt, since) if pos is None else read_backward(
        logs, pos, count, flt, since
    )
    row, nothing = _page_row(logs, page, since)
    asked = F.col("total") if pos is None else F.lit(pos)
    first = F.when(nothing, 0).when(F.col("lines") == 0, asked).otherwise(F.col("_first"))
    return row.select(*_columns(first, F.when(nothing, 0).otherwise(asked)))
