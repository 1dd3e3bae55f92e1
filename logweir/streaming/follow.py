"""Following a log that grows: new lines, filtered and formatted, as a stream or poll by poll."""

import json
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from logweir.functions import fixed
from logweir.functions.predicates import LogFilter, all_of, message_filter, since
from logweir.operators.positions import running_sums
from logweir.operators.views import format_line
from logweir.schemas import LOG
from logweir.sources import files
from logweir.sources.chain import parse_jsonl
from logweir.sources.store import LogStore

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def follow_log(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
) -> DataFrame:
    """New JSONL lines of a folder of finished files, parsed; the query's checkpoint is the cursor."""
    reader = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_jsonl(reader.text(path).withColumnRenamed("value", "line"))


def follow_table(
    spark: SparkSession, path: str, sink: str, from_pos: int = -1,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """New rows of one sink of the log table.

    ``from_pos`` set to the log's current tail offset starts at the end, without history.
    """
    reader = spark.readStream.schema(LOG)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).filter(all_of(F.col("sink") == sink, since(from_pos)))


def follow_store(
    spark: SparkSession, out: str, sink: str | None = None, from_pos: int = -1,
    max_commits_per_trigger: int | None = None,
) -> DataFrame:
    """New rows of a log store, or of one sink, as they are committed; see :func:`follow_table`.

    The stream reads the commits, each one small file that names its new data files, and tasks open those. Files
    that no commit names are never seen, and merging files adds no row. A file that retention has deleted meanwhile
    is skipped; ``vacuum`` must keep more versions than the slowest follower lags behind.
    """
    added = "added array<struct<sink string, path string, pos_lo long, pos_hi long>>"
    reader = spark.readStream.schema(added).option("pathGlobFilter", "*.json")
    if max_commits_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_commits_per_trigger)
    named = reader.json(f"{out}/commits").select(F.explode("added").alias("file")).select("file.*")
    wanted = named.filter(all_of(F.col("sink") == sink if sink is not None else None, F.col("pos_hi") > from_pos))
    schema = to_arrow_schema(LOG)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = files.file_system(f"{out}/{path}")
                try:
                    source = system.open_input_file(place)
                except FileNotFoundError:
                    continue
                with source:
                    for rows in pq.ParquetFile(source).iter_batches(4096):
                        yield rows.cast(schema)

    rows = wanted.repartition("path").mapInArrow(task, LOG)
    return rows.filter(all_of(since(from_pos)))


class LinePoll:
    """Polls of one sink, at most ``count`` lines each, with a cursor that outlives the reader.

    The cursor is a position, kept in one small file below the store, so a poll goes on inside a data file and merging
    files changes nothing. A poll that found fewer lines than it may return has caught up with the log as it was.
    """

    def __init__(self, store: LogStore, sink: str, name: str, flt: LogFilter | None = None, start: int = 0):
        self.store, self.sink, self.flt, self.start = store, sink, flt, start
        self.path = f"{store.out}/cursors/{name}.json"

    def position(self) -> int:
        return json.loads(files.read(self.path))["position"] if files.exists(self.path) else self.start

    def poll(self, count: int = fixed.POLL_LINES) -> DataFrame:
        """The next lines; the cursor moves behind them, or to the end of the log where they are fewer than ``count``."""
        at = self.store.commit()
        here = self.position()
        if at is None:
            return self.store.sink(self.sink).forward(here, 0)
        ends = self.store.state(at).filter(F.col("sink") == self.sink).select("total").first()
        page = self.store.sink(self.sink, at).forward(here, count, self.flt)
        last = page.agg(F.count("*").alias("n"), F.max(F.col("pos") + F.col("nbytes")).alias("end")).first()
        following = last.end if last.n == count else max(here, ends.total if ends else 0)
        self._move(following)
        return page

    def _move(self, position: int) -> None:
        files.put(self.path, json.dumps({"position": position}).encode())

    def full_polls(self, count: int = fixed.POLL_LINES, columns: tuple[str, ...] = tuple(LOG.names)) -> tuple[DataFrame, int]:
        """All polls that find ``count`` lines, in one pass: their rows with the number of the poll, and how many polls.

        The rows are those that :meth:`poll` returns call by call, and the cursor moves behind the last of them, so the
        poll after this finds fewer. Rows are numbered by Spark, so a long log costs one pass and not a job for each poll.
        """
        at, here = self.store.commit(), self.position()
        log = self.store.sink(self.sink, at)
        rows = log.forward(here, 0) if at is None else log.after(here, self.flt)
        wanted = dict.fromkeys((*columns, "sink", "pos", "nbytes"))
        ranked = running_sums(rows.select(*wanted, F.lit(1).cast("long").alias("_one")), {"_rank": "_one"}, ["sink"], "pos")
        full = ranked.count() // count
        if full:
            self._move(ranked.where(F.col("_rank") == full * count - 1).select(F.col("pos") + F.col("nbytes")).first()[0])
        poll = F.floor(F.col("_rank") / count).cast("int").alias("poll")
        return ranked.where(F.col("_rank") < full * count).select(poll, *columns), full


def follow(
    rows: DataFrame, flt: LogFilter | None = None, include: Iterable[str] = (),
    exclude: Iterable[str] = (), columns: tuple[str, ...] = fixed.LINE_COLUMNS,
    style: str = "short",
) -> DataFrame:
    """Rows of a log, stream or table, that pass both filters, each with its console ``text``."""
    condition: Column = message_filter(include, exclude)
    if flt is not None:
        condition = all_of(flt.condition(canonical=False), condition)
    return format_line(rows.filter(condition), columns, style)
