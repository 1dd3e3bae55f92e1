"""Captured datagrams as a table or a stream of landing files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.schemas import DATAGRAM

#: Where a datagram without a number was read from.
PLACE = {"file_time": "_metadata.file_modification_time", "file_name": "_metadata.file_path", "row_index": "_metadata.row_index"}

#: Most datagrams that one task parses and fans out at a time; a row group of a file may hold a million.
SPREAD_ROWS = 50_000


def spread(datagrams: DataFrame) -> DataFrame:
    """The same datagrams dealt out over tasks of bounded size, while they are narrow.

    Parsed and fanned out they are several times as large, and what one task sends on would not fit its memory.
    """
    parts = -(-datagrams.count() // SPREAD_ROWS)
    return datagrams.repartition(parts, "seq") if parts > 1 else datagrams


def read_datagrams(spark: SparkSession, path: str) -> DataFrame:
    """(seq, rcv, src, payload) rows of a parquet folder."""
    return spark.read.schema(DATAGRAM).parquet(path)


def stream_datagrams(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, numbered: bool = True
) -> DataFrame:
    """The same rows as they land; the file cap bounds one micro-batch.

    With ``numbered`` off the source has no ``seq``, and rows carry the place they were read from instead,
    from which ingest counts arrivals.
    """
    schema = DATAGRAM if numbered else T.StructType([f for f in DATAGRAM if f.name != "seq"])
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(path)
    return rows if numbered else rows.select("*", *[F.col(c).alias(n) for n, c in PLACE.items()])
