"""Writers: text and JSONL segments, the parquet log table, forwarded payloads."""

import sys
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.text import octets, sanitize_utf8
from logweir.operators.parse import to_jsonl
from logweir.operators.segments import generation_name
from logweir.schemas import LOG
from logweir.session import materialize
from logweir.sources import files

# Task functions travel with the job, so executors need no installed copy of this package.
for _module in (sys.modules[__name__], files):
    cloudpickle.register_pickle_by_value(_module)

FILE_BYTES = 256 << 20  # most bytes of one segment written by one task
GROUP_ROWS, GROUP_BYTES = 1 << 16, 32 << 20  # rows of a segment that are held until they are written
TASK_SEGMENTS = 500  # segments that one task deletes


def to_logs(routed: DataFrame) -> DataFrame:
    """Routed records plus ``line``, ``nbytes`` and the bytes each adds to its two outputs.

    An output a sink does not write (``write_text``, ``write_jsonl``) adds nothing.
    """
    lines = routed if "line" in routed.columns else to_jsonl(routed)
    sized = lines.withColumn("nbytes", octets(F.col("line")))
    text = octets(F.col("raw"))

    def written(flag: str, size):
        return F.when(F.col(flag), size).otherwise(F.lit(0)) if flag in routed.columns else size

    return sized.withColumn("text_bytes", written("write_text", text).cast("long")).withColumn(
        "json_bytes", written("write_jsonl", F.col("nbytes")).cast("long")
    )


def _clustered(logs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows gathered per segment and sorted, a big segment being shared by several tasks.

    Runs of 2**16 consecutive order keys, or of ``FILE_BYTES`` where positions are known, stay
    together, so neither one busy sink nor one endless segment ends up in a single task.
    """
    chunk = (
        F.floor(F.col("pos") / FILE_BYTES) if order == "pos" else F.shiftright(order, 16)
    )
    return (
        logs.withColumn("_chunk", chunk).repartition(*keys, "_chunk")
        .sortWithinPartitions(*keys, "_chunk", order).drop("_chunk")
    )


def _keys(df: DataFrame) -> list[str]:
    return [k for k in ("sink", "generation") if k in df.columns]


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One raw payload per line, a folder per sink and generation; bad bytes become U+FFFD."""
    keys = _keys(df)
    text = df.select("seq", *keys, sanitize_utf8(F.col("raw")).alias("value"))
    _clustered(text, keys, "seq").drop("seq").write.mode(mode).partitionBy(*keys).text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per line, a folder per sink and generation."""
    keys = _keys(df)
    lines = df if "line" in df.columns else to_jsonl(df)
    text = lines.select("seq", *keys, F.col("line").alias("value"))
    _clustered(text, keys, "seq").drop("seq").write.mode(mode).partitionBy(*keys).text(path)


class _SegmentFile:
    """The file of one segment while a task writes it, some rows at a time. It gets its name when it is whole."""

    def __init__(self, folder: str, name: str, schema: pa.Schema):
        self.system, place = files.file_system(folder)
        self.system.create_dir(place, recursive=True)
        self.staged, self.place = f"{place}/_{name}-{uuid.uuid4().hex}", f"{place}/{name}"
        self.writer = pq.ParquetWriter(self.staged, schema, filesystem=self.system, store_schema=False)
        self.schema, self.held, self.rows, self.size = schema, [], 0, 0

    def add(self, rows: pa.RecordBatch) -> None:
        self.held.append(rows)
        self.rows, self.size = self.rows + rows.num_rows, self.size + rows.nbytes
        if self.rows >= GROUP_ROWS or self.size >= GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held, self.schema))
            self.held, self.rows, self.size = [], 0, 0

    def close(self) -> None:
        self._flush()
        self.writer.close()
        self.system.move(self.staged, self.place)


def _segment_files(rows: DataFrame, path: str) -> None:
    """Rows that lie together by sink and generation as one parquet file per segment and task, in partition folders.

    A segment is small, so what a file costs to open and close decides; Arrow does it in a tenth of the time that
    Spark's own writer takes. A task that runs again replaces its files by equal ones.
    """
    name = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, key, written = TaskContext.get().partitionId(), None, 0
        file: _SegmentFile | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sinks, generations = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            data = batch.select(batch.schema.names[:-2])
            changes = np.ones(batch.num_rows, bool)
            sink = sinks.dictionary_encode().indices.fill_null(-1).to_numpy()
            generation = generations.fill_null(-1).to_numpy()
            changes[1:] = (sink[1:] != sink[:-1]) | (generation[1:] != generation[:-1])
            edges = np.flatnonzero(changes).tolist()
            for low, high in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                own = (sinks[low].as_py(), generations[low].as_py())
                if file is None or own != key:
                    if file:
                        file.close()
                    file = _SegmentFile(f"{path}/{_segment_folder(*own)}", f"part-{part:06d}-{written:06d}-{name}.parquet", data.schema)
                    key, written = own, written + 1
                file.add(data.slice(low, high - low))
        if file:
            file.close()
        yield pa.RecordBatch.from_pydict({"written": pa.array([written], pa.int64())})

    rows.mapInArrow(write, "written long").agg(F.sum("written")).first()


def write_logs(df: DataFrame, path: str, mode: str = "overwrite", clustered: bool = False) -> None:
    """The queried form: parquet per sink and generation, sorted by position inside each file.

    The files are written beside the table, which appears whole: a job that fails leaves nothing in it.
    ``clustered`` rows come in runs of consecutive ``seq`` of a sink, as ``assign_generations`` gives them, and are
    written as they lie; others are gathered per segment first.
    """
    if files.names(path) and mode in ("error", "errorifexists", "ignore"):
        if mode == "ignore":
            return
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    try:
        logs = df.select(*LOG.names)
        _segment_files(logs if clustered else _clustered(logs, ["sink", "generation"], "pos"), staged)
        files.put(f"{staged}/_SUCCESS", b"")
        if mode == "append" and files.exists(path):
            _move_segments(df.sparkSession, staged, path)
        else:
            files.delete(path)
            files.publish(staged, path)
    finally:
        files.delete(staged)


def _move_segments(spark: SparkSession, source: str, target: str) -> None:
    """Move the files of all segments into a table that is there already; tasks move, spread over the cluster."""
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for folder in found.column(0).to_pylist():
                for name in files.names(f"{source}/{folder}"):
                    files.move_file(f"{source}/{folder}/{name}", f"{target}/{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"moved": pa.array([1], pa.int64())})

    folders = segment_folders(spark, source).select("folder")
    parts = -(-folders.count() // TASK_SEGMENTS)
    folders.repartition(max(1, parts), "folder").mapInArrow(move, "moved long").agg(F.sum("moved")).first()


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The log table written by :func:`write_logs`."""
    return spark.read.schema(LOG).parquet(path)


def deliver(forwards: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Forwarded payloads as parquet, a folder per target."""
    forwards.write.mode(mode).partitionBy("target").parquet(path)


def drop_segments(gone: DataFrame, out: str, outputs: tuple[str, ...] = ("logs", "jsonl", "text")) -> int:
    """Delete the folders of ``gone`` (batch, sink, generation) rows in every output; returns how many.

    A null batch stands for a table without batches. Tasks delete, spread over the cluster.
    """
    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped = 0
        for found in batches:
            for row in found.to_pylist():
                batch = "" if row["batch"] is None else f"/batch={row['batch']}"
                for output in outputs:
                    dropped += files.delete(f"{out}/{output}{batch}/{_segment_folder(row['sink'], row['generation'])}")
        yield pa.RecordBatch.from_pydict({"dropped": [dropped]})

    # A number given by hand is not made smaller by adaptive execution, which goes by bytes.
    parts = max(1, -(-gone.count() // TASK_SEGMENTS))
    dealt = gone.repartition(parts, "batch", "sink", "generation")
    removed = dealt.mapInArrow(delete, "dropped long").agg(F.sum("dropped")).first()[0]
    return removed or 0


#: Characters that a partition folder's name holds as % and two hexadecimal digits.
_ESCAPED = set("\"#%'*/:=?\\{[]^") | {chr(c) for c in (*range(1, 32), 127)}
#: The value that stands for null, and for no text, in a partition folder's name.
_NONE = "__HIVE_DEFAULT_PARTITION__"


def _escaped(name: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in name)


def _segment_folder(sink: str | None, generation: int | None) -> str:
    return f"sink={_escaped(sink) if sink else _NONE}/generation={_NONE if generation is None else generation}"


def _value(folder: str) -> str | None:
    held = folder.partition("=")[2]
    return None if held == _NONE else unquote(held)


def segment_folders(spark: SparkSession, path: str) -> DataFrame:
    """(batch, sink, generation, folder) of every segment of a log table, with batch folders or without, from the
    names of its folders. Tasks list a batch or a sink at a time, and no file is opened."""
    def listed(folder: str, start: str) -> Iterator[str]:
        yield from (f"{folder}/{n}" for n in files.names(f"{path}/{folder}") if n.startswith(start))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for top in found.column(0).to_pylist():
                for sink in listed(top, "sink=") if top.startswith("batch=") else [top]:
                    rows = [(*map(_value, folder.split("/")), folder) for folder in listed(sink, "generation=")]
                    rows = [(None, *row) if len(row) == 3 else row for row in rows]
                    for low in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.string()) for c in zip(*rows[low:low + 10_000], strict=True)],
                            names=["batch", "sink", "generation", "folder"])

    tops = sorted(n for n in files.names(path) if n.startswith(("batch=", "sink=")))  # one per batch or sink
    dealt = spark.createDataFrame([(n,) for n in tops], "folder string").repartition("folder")
    named = dealt.mapInArrow(segments, "batch string, sink string, generation string, folder string")
    return materialize(named.select(
        F.col("batch").cast("long"), "sink", F.col("generation").cast("long"), "folder"), "segment-folders")


def drop_expired(spark: SparkSession, path: str, routes: DataFrame) -> int:
    """Delete the segment folders of a log table, with batch folders or without, that retention no
    longer keeps; returns how many."""
    stored = segment_folders(spark, path).drop("folder")
    expired = generation_name(stored).join(routes.select("sink", "max_files"), "sink").filter(
        (F.col("max_files") > 0) & (F.col("age") > F.col("max_files"))
    )
    out, _, name = path.rpartition("/")
    return drop_segments(expired.select("batch", "sink", "generation"), out, (name,))
