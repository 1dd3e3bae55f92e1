"""What the text operators share: words, the shared work folder, prefix sums over range partitions."""

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.session import scratch_dir

#: Rows that travel to a Python worker at a time.
BATCH_ROWS = 2000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: A word is a run of bytes other than the space and the controls TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; without an argument ``bytes.split`` cuts exactly at 20 and 09-0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names."""
    return f"{scratch_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written below a work folder and read again: computed once, and safe when executors are lost."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """``df`` through a function of an iterator of Arrow batches, in no need of pandas.

    Workers outlive their tasks, so what a task has held goes back to the system at its end. Rows go to a worker
    BATCH_ROWS at a time, which bounds what both sides hold of long texts.
    """
    if int(df.sparkSession.conf.get(_ROWS_KEY)) > BATCH_ROWS:
        df.sparkSession.conf.set(_ROWS_KEY, BATCH_ROWS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def release() -> None:
    """Hand memory that is free again back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of every row, one Arrow batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, at_most: int = 2000, heavy: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a bounded number of rows and, for text and bytes, of bounded size."""
    wide = [i for i, f in enumerate(schema) if f.type in (pa.string(), pa.binary(), pa.large_string())]
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(row[i]) for i in wide if row[i] is not None)
        if len(held) >= at_most or size >= heavy:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def partitions_for(df: DataFrame) -> int:
    """The session's number of shuffle partitions; range partitioning is not re-sized by adaptive execution."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, order: list[Column], value: str, folder: str) -> DataFrame:
    """``df`` with ``before``, the exact sum of ``value`` over all rows earlier in the order.

    Rows are range-partitioned by the order, each partition sums its own rows in order, and the sums of
    whole partitions (one row per partition, however large the input is) give the bases. The ranged rows
    are written once, since a second evaluation might draw other range bounds. A hot key is no hot task as
    long as the order goes on below it. Columns of ``df`` must not be named ``part`` or ``before``.
    """
    ranged = df.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order)
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["part int", "before bigint"]

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(own, dtype=np.int64)
            if len(own):
                columns = [*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(ends - own)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "before"])
                total = int(ends[-1])

    rows = kept(arrow_map(ranged, running, ", ".join(schema)), folder, "prefix")
    sums = rows.groupBy("part").agg(F.sum(value).alias("whole")).collect()  # one row per partition
    base, at = 0, []
    for row in sorted(sums, key=lambda r: r["part"]):
        at.append((row["part"], base))
        base += row["whole"]
    bases = df.sparkSession.createDataFrame(at, "part int, base bigint")
    joined = rows.join(F.broadcast(bases), "part")  # at most as many rows as there are partitions
    return joined.select(*df.columns, (F.col("before") + F.col("base")).alias("before"))
