"""Full search of one log with the true number of matches, and facets."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions import fixed
from logweir.functions.labels import facility_label
from logweir.functions.predicates import LogFilter, all_of, includes_any, since as from_position
from logweir.operators.paging import _condition, _first


def _matches(logs: DataFrame, q: str, flt: LogFilter | Column | None, since: int) -> DataFrame:
    wanted = includes_any(F.col("line"), [q]) if q else None
    return logs.filter(all_of(from_position(since), _condition(flt), wanted))


def search(
    logs: DataFrame, q: str, limit: int = fixed.PAGE_LINES,
    flt: LogFilter | Column | None = None, since: int = -1,
) -> DataFrame:
    """The first ``limit`` lines holding ``q`` (any case) that pass the filter, oldest first."""
    return _first(_matches(logs, q, flt, since), limit)


def search_count(
    logs: DataFrame, q: str, flt: LogFilter | Column | None = None, since: int = -1
) -> DataFrame:
    """One row: how many lines match, whatever the limit of the shown page."""
    return _matches(logs, q, flt, since).agg(F.count("*").alias("total_matches"))


def search_numbered(
    logs: DataFrame, q: str, limit: int = fixed.PAGE_LINES,
    flt: LogFilter | Column | None = None, since: int = -1,
) -> DataFrame:
    """Search hits with ``k``, ``shown``, ``total_matches`` and their counter text.

    ``next_k`` and ``prev_k`` step through the shown hits and wrap around at both ends. The windows
    see the limited result only.
    """
    hits = search(logs, q, limit, flt, since)
    everything = Window.partitionBy(F.lit(0))
    numbered = hits.select(
        "*",
        F.row_number().over(everything.orderBy("pos")).alias("k"),
        F.count("*").over(everything).cast("int").alias("shown"),
        search_count(logs, q, flt, since).scalar().alias("total_matches"),
    )
    k, shown, total = F.col("k"), F.col("shown"), F.col("total_matches")
    long_form = F.format_string("%d / %d (of %d)", k, shown, total)
    return numbered.select(
        "*",
        F.when(total > shown, long_form)
        .otherwise(F.format_string("%d / %d", k, total)).alias("counter"),
        (k % shown + 1).cast("int").alias("next_k"),
        F.when(k == 1, shown).otherwise(k - 1).alias("prev_k"),
    )


def facet(rows: DataFrame, column: Column | None = None, counts: bool = False) -> DataFrame:
    """Distinct facility labels present, sorted; with their row counts on request."""
    label = facility_label(F.col("facility")) if column is None else column
    labels = rows.select(label.alias("label"))
    found = labels.groupBy("label").agg(F.count("*").alias("n")) if counts else labels.distinct()
    return found.orderBy("label")
