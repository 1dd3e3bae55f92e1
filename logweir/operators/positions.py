"""Byte positions of lines in a log: exact running sums over a total order, without one big window.

The order key is cut into digits of 16 bits. Rows are summed inside one key range, ranges inside a
range of ranges, and so on, so no window ever holds more than 65,536 rows of one log. Rows are computed
and shuffled once, and written with their sums inside the range; the totals of ranges come from that table.
"""

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.functions.text import octets
from logweir.operators.joins import BROADCAST_ROWS
from logweir.session import materialize

DIGIT_BITS = 16
LEVELS = 4  # four digits hold every non-negative 64-bit key, so no window is larger


def _before(sums: dict[str, str], group: list[str | Column], order: str) -> list[Column]:
    """Totals over the earlier rows of the group."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.sum(s).over(window), F.lit(0)).alias(n) for n, s in sums.items()]


def _small_sums(df: DataFrame, sums: dict[str, str], by: list[str], order: str, levels: int) -> DataFrame:
    """:func:`running_sums` over totals of ranges, range upon range, in one plan."""
    if levels <= 1:
        return df.select("*", *_before(sums, by or [F.lit(0)], order))
    ranged = df.withColumn("_range", F.shiftright(order, DIGIT_BITS))
    group = [*by, "_range"]
    totals = ranged.groupBy(*group).agg(*[F.sum(s).alias(f"_t_{s}") for s in set(sums.values())])
    bases = _small_sums(
        totals.withColumnRenamed("_range", "_key"), {f"_base_{n}": f"_t_{s}" for n, s in sums.items()}, by, "_key", levels - 1
    ).select(*by, F.col("_key").alias("_range"), *[f"_base_{n}" for n in sums])
    joined = ranged.select("*", *_before(sums, group, order)).join(bases, group)
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_base_{n}")).alias(n) for n in sums])


def running_sums(
    df: DataFrame, sums: dict[str, str], by: list[str], order: str = "seq", levels: int = LEVELS
) -> DataFrame:
    """Add, for each ``{new: size}`` pair, the total of ``size`` over the rows before this one.

    ``order`` must be a non-negative whole number, unique within ``by``. The rows are written once, in the
    order of their ranges, and what follows reads that table: one scan and one evaluation of ``df``.
    """
    return summed_once(df, sums, by, order, levels)[0]


def summed_once(
    df: DataFrame, sums: dict[str, str], by: list[str], order: str = "seq", levels: int = LEVELS, carried: tuple[str, ...] = (),
) -> tuple[DataFrame, list[Row] | None]:
    """:func:`running_sums`, and the totals of the ranges where they are few (null where they are not).

    A row of totals has ``by``, ``_range``, a total ``_t_<size>`` of each size, and ``carried`` columns, which are
    the same in all rows of a log. It stands for up to 65,536 rows, so a table of many billions has few enough of
    them to go to the tasks with the plan; beyond BROADCAST_ROWS they are summed and joined as tables.
    """
    if levels <= 1:
        return df.select("*", *_before(sums, by or [F.lit(0)], order)), None
    key = F.coalesce(F.col(order), F.lit(0).cast("long"))
    group = [*by, "_range"]
    ranged = df.withColumn("_range", F.shiftright(key, DIGIT_BITS))
    inside = materialize(ranged.select("*", *_before(sums, group, order)), "ranged")
    totals = inside.groupBy(*group).agg(*[F.sum(s).alias(f"_t_{s}") for s in set(sums.values())], *[F.first(c).alias(c) for c in carried])
    found = totals.limit(BROADCAST_ROWS + 1).collect()
    above = {f"_base_{n}": f"_t_{s}" for n, s in sums.items()}
    if len(found) <= BROADCAST_ROWS:
        counted = dict.fromkeys(above.values())
        shape = T.StructType([T.StructField("_key" if c == "_range" else c, inside.schema[c].dataType) for c in group] + [
            T.StructField(n, T.LongType()) for n in counted])
        rows = df.sparkSession.createDataFrame([tuple(row[c] for c in (*group, *counted)) for row in found], shape)
        small = _small_sums(rows, above, by, "_key", 2)  # of so few rows two levels are enough
        bases = F.broadcast(small.select(*by, F.col("_key").alias("_range"), *above))
    else:
        found = None
        renamed = materialize(totals, "totals").withColumnRenamed("_range", "_key")
        bases = _small_sums(renamed, above, by, "_key", levels - 1).select(*by, F.col("_key").alias("_range"), *above)
    joined = inside.join(bases, group)
    return joined.select(
        *df.columns, *[(F.col(n) + F.col(f"_base_{n}")).alias(n) for n in sums]
    ), found


def with_positions(logs: DataFrame, by: list[str] | None = None, order: str = "seq") -> DataFrame:
    """Add ``nbytes`` (line and newline) and ``pos``, the byte at which the line starts.

    One log per value of ``by``; by default per ``sink`` where the column exists.
    """
    if by is None:
        by = ["sink"] if "sink" in logs.columns else []
    if "nbytes" not in logs.columns:
        logs = logs.withColumn("nbytes", octets(F.col("line")))
    return running_sums(logs, {"pos": "nbytes"}, by, order)


def relative_positions(logs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add ``rel_pos``: the position counted from the oldest line still present."""
    by = ["sink"] if by is None else by
    oldest = logs.groupBy(*by).agg(F.min("pos").alias("_oldest"))
    # One row per log: the number of sinks, not of lines.
    return (
        logs.join(F.broadcast(oldest), by)
        .withColumn("rel_pos", F.col("pos") - F.col("_oldest")).drop("_oldest")
    )


def log_summary(logs: DataFrame) -> DataFrame:
    """One row: ``total`` and ``tail_offset``, both the size of the log in bytes, 0 if empty."""
    total = F.coalesce(F.sum("nbytes"), F.lit(0))
    return logs.agg(total.alias("total"), total.alias("tail_offset"))


def segment_table(logs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Start, size and row count of every stored segment."""
    by = [] if by is None else by
    return logs.groupBy(*by, "generation").agg(
        F.min("pos").alias("start"), F.sum("nbytes").alias("size"), F.count("*").alias("lines")
    )


def locate(logs: DataFrame, positions: list[int]) -> DataFrame:
    """(position, generation, offset) for each position of one log.

    A position at or past the end is the end of the last segment. One pass over the segment table,
    which is aggregated to one row.
    """
    segments = segment_table(logs)
    holder = F.struct("generation", "start", "size")
    found = segments.agg(
        F.array(*[
            F.struct(
                F.lit(p).cast("long").alias("position"),
                F.max_by(F.when(F.col("start") <= p, holder),
                         F.when(F.col("start") <= p, F.col("start"))).alias("at"),
            )
            for p in positions
        ]).alias("hits")
    )
    hit = found.select(F.explode("hits").alias("h")).select("h.position", "h.at")
    return hit.filter("at IS NOT NULL").select(
        "position", F.col("at.generation").alias("generation"),
        F.least(F.col("position") - F.col("at.start"), F.col("at.size")).alias("offset"),
    )
