"""Arrival numbers for a source that has none."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.joins import join_small

ORDER = ("file_time", "file_name", "row_index")


def number_arrivals(datagrams: DataFrame, first: int = 0) -> tuple[DataFrame, int]:
    """Datagrams with ``seq`` counting up from ``first`` without gaps, and the number after the last.

    Datagrams that have ``seq`` keep it. Others come with the place they were read from (``datagrams.PLACE``): files
    stand in order of time and name, rows in order inside their file. A batch that is read again has the same files, so
    its numbers are the same. Only the files' row counts are shuffled and summed; no row moves.
    """
    if "seq" in datagrams.columns:
        return datagrams, first
    counts = datagrams.groupBy("file_time", "file_name").agg((F.max("row_index") + 1).alias("rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("file_time", "file_name").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(  # one row per file of the batch
        "file_name", "rows", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) + first).alias("_base"))
    placed = join_small(datagrams, bases.drop("rows"), ["file_name"], spread="row_index")
    last = bases.agg(F.max(F.col("_base") + F.col("rows"))).first()[0]
    numbered = placed.withColumn("seq", (F.col("_base") + F.col("row_index")).cast("long"))
    return numbered.drop("_base", *ORDER), first if last is None else last
