"""Pages of a stored log table that read only the segments they need."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import fixed
from logweir.functions.predicates import LogFilter
from logweir.operators import paging, search
from logweir.sources.sinks import read_logs


class LogTable:
    """One sink of a stored log table.

    A page is looked for in the nearest segments first and in four times as many after each miss,
    so its cost follows the distance to the last row it returns, not the size of the log. Where a
    page starts is looked up in ``segments`` (sink, generation, start), the small table ingest keeps;
    without it the positions of the log itself are read.
    """

    def __init__(
        self, spark: SparkSession, path: str, sink: str, segments: DataFrame | None = None
    ):
        self.rows = read_logs(spark, path).filter(F.col("sink") == sink)
        self._starts = (
            self.rows.select("generation", F.col("pos").alias("start")) if segments is None
            else segments.filter(F.col("sink") == sink).select("generation", "start")
        )

    def _range(self) -> tuple[int, int] | None:
        ends = self._starts.agg(
            F.min("generation").alias("lo"), F.max("generation").alias("hi")
        ).first()
        return None if ends.lo is None else (ends.lo, ends.hi)

    def _containing(self, pos: int) -> int | None:
        """Newest generation with a line starting at or before ``pos``."""
        return self._starts.filter(F.col("start") <= pos).agg(F.max("generation")).first()[0]

    def between(self, lo: int, hi: int) -> DataFrame:
        """Rows of the generations from ``lo`` to ``hi``; no others are read."""
        return self.rows.filter(F.col("generation").between(lo, hi))

    def _grow(self, lo: int, hi: int, count: int, newest: bool, page) -> DataFrame:
        span = 1
        while True:
            ends = (max(lo, hi - span + 1), hi) if newest else (lo, min(hi, lo + span - 1))
            rows = page(self.between(*ends)).collect()  # at most ``count`` rows: the page itself
            if span > hi - lo or len(rows) >= count:
                return self.rows.sparkSession.createDataFrame(rows, self.rows.schema)
            span *= 4

    def forward(
        self, pos: int, count: int = fixed.PAGE_LINES, flt: LogFilter | Column | None = None,
        since: int = -1,
    ) -> DataFrame:
        """:func:`paging.read_forward` from the segment that holds the position."""
        ends = self._range()
        if ends is None or count <= 0:
            return self.rows.limit(0)
        first = self._containing(max(pos, since))
        lo = ends[0] if first is None else first
        return self._grow(
            lo, ends[1], count, False, lambda df: paging.read_forward(df, pos, count, flt, since)
        )

    def backward(
        self, pos: int, count: int = fixed.PAGE_LINES, flt: LogFilter | Column | None = None,
        since: int = -1,
    ) -> DataFrame:
        """:func:`paging.read_backward` from the segment that holds the position."""
        ends, last = self._range(), self._containing(pos)
        if ends is None or last is None or count <= 0:
            return self.rows.limit(0)
        return self._grow(
            ends[0], last, count, True, lambda df: paging.read_backward(df, pos, count, flt, since)
        )

    def tail(
        self, n: int = fixed.PAGE_LINES, flt: LogFilter | Column | None = None, since: int = -1
    ) -> DataFrame:
        """:func:`paging.tail` from the newest segments."""
        ends = self._range()
        if ends is None or n <= 0:
            return self.rows.limit(0)
        return self._grow(*ends, n, True, lambda df: paging.tail(df, n, flt, since))

    def search(
        self, q: str, limit: int = fixed.PAGE_LINES, flt: LogFilter | Column | None = None,
        since: int = -1,
    ) -> DataFrame:
        """:func:`search.search`: reads the whole sink, positions before ``since`` skipped."""
        return search.search(self.rows, q, limit, flt, since)

    def search_count(
        self, q: str, flt: LogFilter | Column | None = None, since: int = -1
    ) -> DataFrame:
        return search.search_count(self.rows, q, flt, since)
