"""A log store: data files of bounded size with what is in them known beforehand, and pages that open only what they need.

Rows of a sink are sorted by position and cut into files. The task that writes a file also writes the text and
JSONL lines of its segments and returns one catalogue row: positions, generations, severities, facilities, a sketch
of three-byte runs, and for each segment its size, its lines by facility and severity, and where its lines are.
Catalogue rows are a table of their own; a commit (see ``manifest``) makes them visible.
"""

import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from logweir.functions import fixed, grams
from logweir.functions.labels import facility_label
from logweir.functions.predicates import LogFilter, all_of, clean, includes_any, since as from_position
from logweir.functions.text import byte_view, is_utf8, repair_view
from logweir.schemas import FILE, LOG, STATE
from logweir.session import materialize
from logweir.sources import files, manifest
from logweir.sources.manifest import Commit

# Task functions travel with the job, so executors need no installed copy of this package.
for _module in (sys.modules[__name__], files, grams):
    cloudpickle.register_pickle_by_value(_module)

#: Most bytes of log in a data file, so of what one task writes at a time; rows of a row group.
FILE_BYTES, GROUP_ROWS = 128 << 20, 1 << 16
#: Small files that one task reads or deletes, and bytes of lines that it reads at a time.
TASK_FILES, READ_BYTES = 500, 4 << 20
#: A page opens so many files first, and four times as many after each miss.
FIRST_FILES = 2


def escaped(name: str) -> str:
    """A sink's name as a folder's name."""
    return "".join(c if c.isalnum() and c.isascii() or c in "-_" else f"%{ord(c):X}." for c in name)


class _OpenFile:
    """One data file while a task writes it, with the outputs of its segments."""

    def __init__(self, out: str, batch: int, sink: str, schema: pa.Schema, outputs: tuple[str, ...]):
        self.out, self.batch, self.sink, self.outputs = out, batch, sink, outputs
        self.name = f"{batch:012d}-{uuid.uuid4().hex}"
        self.path = f"data/{escaped(sink)}/{self.name}.parquet"
        self.schema, self.held, self.rows = schema, [], 0
        self.writer = pq.ParquetWriter(self._open(self.path), schema, compression="zstd")
        self.seen = np.zeros(grams.BITS, bool)
        self.names = {"severity": set(), "facility": set()}
        self.parts: list[dict] = []
        self.streams: dict[str, object] = {}
        self.pos_lo = self.pos_hi = None

    def _open(self, path: str):
        system, place = files.file_system(f"{self.out}/{path}")
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(place)

    def add(self, rows: pa.RecordBatch, generations: np.ndarray, lowered: pa.Array, repaired: pa.Array) -> None:
        """Rows in order of position; ``lowered`` and ``repaired`` hold what differs from the plain bytes."""
        self.held.append(rows)
        self.rows += rows.num_rows
        if sum(r.num_rows for r in self.held) >= GROUP_ROWS:
            self._flush()
        lines = rows.column("line")
        self._mark(lines)
        self._mark(lowered.drop_null())
        pos, nbytes = rows.column("pos").to_numpy(), rows.column("nbytes").to_numpy()
        if self.pos_lo is None:
            self.pos_lo = int(pos[0])
        self.pos_hi = int(pos[-1] + nbytes[-1])
        edges = np.flatnonzero(np.diff(generations, prepend=generations[0] - 1, append=generations[-1] + 1))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            self._segment(int(generations[low]), rows.slice(low, high - low), repaired.slice(low, high - low))

    def _mark(self, lines: pa.Array) -> None:
        raw = "\n".join(lines.to_pylist()).encode("utf-8")
        text = np.frombuffer(raw, np.uint8)
        for start in range(0, max(len(text) - 2, 0), 1 << 22):
            self.seen[grams.places(text[start:start + (1 << 22) + 2])] = True

    def _segment(self, generation: int, rows: pa.RecordBatch, repaired: pa.Array) -> None:
        if not self.parts or self.parts[-1]["generation"] != generation:
            self._close_streams()
            self.parts.append({
                "generation": generation, "start": rows.column("pos")[0].as_py(), "lines": 0, "nbytes": 0, "text_bytes": 0,
                "json_bytes": 0, "text": None, "jsonl": None, "facets": Counter()})
        part = self.parts[-1]
        part["lines"] += rows.num_rows
        for name in ("nbytes", "text_bytes", "json_bytes"):
            part[name] += int(rows.column(name).to_numpy().sum())
        pairs = list(zip(rows.column("facility").to_pylist(), rows.column("severity").to_pylist(), strict=True))
        part["facets"].update(pairs)
        for i, name in enumerate(("facility", "severity")):
            self.names[name].update(p[i] for p in pairs)
        if "text" in self.outputs and int(rows.column("text_bytes").to_numpy().sum()):
            wanted = rows.column("text_bytes").to_numpy() > 0
            lines = zip(wanted.tolist(), rows.column("raw").to_pylist(), repaired.to_pylist(), strict=True)
            self._write("text", generation, b"".join((raw if fixed_raw is None else fixed_raw) + b"\n" for w, raw, fixed_raw in lines if w))
        if "jsonl" in self.outputs and int(rows.column("json_bytes").to_numpy().sum()):
            wanted = rows.column("json_bytes").to_numpy() > 0
            lines = zip(wanted.tolist(), rows.column("line").to_pylist(), strict=True)
            self._write("jsonl", generation, "".join(line + "\n" for w, line in lines if w).encode("utf-8"))

    def _write(self, output: str, generation: int, data: bytes) -> None:
        if output not in self.streams:
            ending = "jsonl" if output == "jsonl" else "log"
            path = f"{output}/{escaped(self.sink)}/{generation:012d}-{self.name}.{ending}"
            self.parts[-1][output] = path
            self.streams[output] = self._open(path)
        self.streams[output].write(data)

    def _close_streams(self) -> None:
        for stream in self.streams.values():
            stream.close()
        self.streams = {}

    def _flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held, self.schema))
            self.held = []

    def close(self) -> dict:
        """The catalogue row."""
        self._flush()
        self._close_streams()
        self.writer.close()
        named = {k: sorted(x for x in v if x is not None) for k, v in self.names.items()}
        parts = [p | {"facets": [{"facility": f, "severity": s, "n": n} for (f, s), n in sorted(
            p["facets"].items(), key=lambda x: (x[0][0] or "", x[0][1] or ""))]} for p in self.parts]
        return {
            "sink": self.sink, "path": self.path, "batch": self.batch, "generation_lo": parts[0]["generation"],
            "generation_hi": parts[-1]["generation"], "pos_lo": self.pos_lo, "pos_hi": self.pos_hi, "lines": self.rows,
            "nbytes": sum(p["nbytes"] for p in parts), "severities": named["severity"], "facilities": named["facility"],
            "grams": grams.bitmap(self.seen), "parts": parts}


def write_files(placed: DataFrame, out: str, batch: int, outputs: tuple[str, ...] = ("text", "jsonl"), file_bytes: int = FILE_BYTES,
                clustered: bool = False) -> DataFrame:
    """Rows with sink, generation and position as files of the store; their catalogue rows.

    A sink's rows are dealt out by ranges of ``file_bytes`` of its log, so neither a busy sink nor an endless
    segment is one task. Rows that lie in long runs already (``clustered``), as positions leave them, stay where and
    as they are, so they are neither sent nor sorted again: a file ends where a run or its ``file_bytes`` end. Each evaluation of the result writes files of its
    own; nothing is ever moved.
    """
    line, raw = F.col("line"), F.col("raw")
    plain = F.octet_length(line) == F.length(line)
    rows = placed.select(
        *LOG.names, F.floor(F.col("pos") / file_bytes).alias("_chunk"),
        F.when(~plain, F.lower(line)).alias("_lowered"),
        F.when(~is_utf8(raw), F.encode(repair_view(byte_view(raw)), "UTF-8")).alias("_repaired"))
    dealt = rows if clustered else rows.repartition("sink", "_chunk").sortWithinPartitions("sink", "pos")
    names, shape, schema = LOG.names, to_arrow_schema(FILE), to_arrow_schema(LOG)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark = None, None
        for found in batches:
            if not found.num_rows:
                continue
            own = pa.RecordBatch.from_arrays([found.column(n).cast(schema.field(n).type) for n in names], schema=schema)
            chunk, sinks = found.column("_chunk").to_numpy(), own.column("sink").to_pylist()
            generations, pos = own.column("generation").to_numpy(), own.column("pos").to_numpy()
            ends = pos + own.column("nbytes").to_numpy()
            other = np.array([a != b for a, b in zip(sinks[1:], sinks[:-1], strict=True)], bool)
            other |= (np.diff(chunk) != 0) | (pos[1:] != ends[:-1])
            edges = np.concatenate([[0], np.flatnonzero(other) + 1, [len(sinks)]]).tolist()
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if mark != (sinks[low], chunk[low], pos[low]):
                    if held:
                        yield pa.RecordBatch.from_pylist([held.close()], shape)
                    held = _OpenFile(out, batch, sinks[low], schema, outputs)
                mark, part = (sinks[low], chunk[high - 1], ends[high - 1]), slice(low, high)
                held.add(own.slice(low, high - low), generations[part], found.column("_lowered").slice(low, high - low),
                         found.column("_repaired").slice(low, high - low))
        if held:
            yield pa.RecordBatch.from_pylist([held.close()], shape)

    return dealt.mapInArrow(task, FILE)


def read_files(spark: SparkSession, out: str, paths: list[str]) -> DataFrame:
    """Rows of the named data files; no folder is listed."""
    if not paths:
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(*[f"{out}/{p}" for p in paths])


def may_match(flt: LogFilter | None, q: str = "") -> Column:
    """Catalogue rows whose files may hold a line that passes the filter and contains ``q``."""
    parts = [grams.may_hold(q)] if q else []
    if flt is not None:
        for column, names, case in (("severities", flt.severities, str.upper), ("facilities", flt.facilities, str.lower)):
            if names:
                spelled = {case(n) for n in clean(names)}
                if column == "severities":
                    spelled |= {full for full, short in zip(fixed.SEVERITY_NAMES, fixed.SEVERITY_SHORT_NAMES) if {full, short} & spelled}
                parts.append(F.arrays_overlap(column, F.array(*map(F.lit, sorted(spelled)))))
        if flt.include:
            held = [grams.may_hold(p) for p in flt.include]
            parts.append(F.greatest(*held) if len(held) > 1 else held[0])
    return all_of(*parts)


class LogStore:
    """The log under a folder, at its newest version when asked."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out

    def commit(self) -> Commit | None:
        return manifest.latest(self.out)

    def state(self, at: Commit | None = None) -> DataFrame | None:
        """One row per sink; None before the first commit."""
        at = at or self.commit()
        return None if at is None else self.spark.createDataFrame(list(at.state), STATE)

    def files(self, at: Commit | None = None) -> DataFrame:
        """Catalogue rows of the files that hold rows which are still kept; ``oldest`` tells which are."""
        at = at or self.commit()
        if at is None:
            return self.spark.createDataFrame([], FILE).withColumn("oldest", F.lit(0).cast("long"))
        rows = self.spark.read.schema(FILE).parquet(*[f"{self.out}/{c}" for c in at.catalogs])
        kept = self.state(at).select("sink", "oldest")  # one row per sink
        return rows.join(F.broadcast(kept), "sink").where("generation_hi >= oldest").select(*FILE.names, "oldest")

    def parts(self, at: Commit | None = None) -> DataFrame:
        """One row for each kept segment in each file: sink, path and the fields of ``schemas.PART``."""
        rows = self.files(at).select("sink", "path", "oldest", F.explode("parts").alias("part"))
        return rows.select("sink", "path", "oldest", "part.*").where("generation >= oldest").drop("oldest")

    def rows(self, condition: Column | None = None) -> DataFrame:
        """Kept rows of the files whose catalogue rows meet the condition."""
        chosen = self.files() if condition is None else self.files().where(condition)
        found = read_files(self.spark, self.out, [r["path"] for r in chosen.select("path").collect()])
        kept = self.state()
        if kept is None:
            return found
        return found.join(F.broadcast(kept.select("sink", "oldest")), "sink").where("generation >= oldest").select(*LOG.names)

    def segments(self) -> DataFrame:
        """Start, size and lines of every kept segment; no log row is read."""
        return self.parts().groupBy("sink", "generation").agg(
            F.min("start").alias("start"), F.sum("nbytes").alias("size"), F.sum("lines").alias("lines"))

    def facets(self, column: str = "facility") -> DataFrame:
        """(sink, name, n): kept lines by facility or severity, from the catalogue alone."""
        told = self.parts().select("sink", F.explode("facets").alias("facet"))
        return told.groupBy("sink", F.col(f"facet.{column}").alias("name")).agg(F.sum("facet.n").alias("n"))

    def facility_facet(self, sink: str) -> DataFrame:
        """Facility labels of a sink with their counts, sorted; see ``search.facet``."""
        mine = self.facets("facility").where(F.col("sink") == sink)
        return mine.groupBy(facility_label(F.col("name")).alias("label")).agg(F.sum("n").alias("n")).orderBy("label")

    def summary(self) -> DataFrame:
        """Per sink: bytes and lines that are kept, and the position at which the log ends."""
        held = self.parts().groupBy("sink").agg(F.sum("nbytes").alias("kept_bytes"), F.sum("lines").alias("kept_lines"))
        return held.join(self.state().select("sink", F.col("total").alias("tail_offset")), "sink")

    def lines(self, output: str) -> DataFrame:
        """(sink, generation, line) of every kept line of the text or JSONL output, read where its files are."""
        out = self.out
        size = F.col("text_bytes" if output == "text" else "json_bytes")
        wanted = self.parts().where(F.col(output).isNotNull()).select("sink", "generation", F.col(output).alias("path"), size.alias("size"))
        told = wanted.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
        # Names are small and what they name is not, so tasks are counted by files and bytes.
        tasks = 1 + told["n"] // TASK_FILES + (told["size"] or 0) // FILE_BYTES
        shape = pa.schema([("sink", pa.string()), ("generation", pa.int64()), ("line", pa.string())])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    for some in files.lines(f"{out}/{row['path']}", READ_BYTES):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["sink"]] * len(some)), pa.array([row["generation"]] * len(some)), pa.array(some, pa.string())], schema=shape)

        return wanted.drop("size").repartition(tasks, "path").mapInArrow(task, "sink string, generation long, line string")

    def sink(self, name: str, at: Commit | None = None) -> "SinkLog":
        """One sink, at a version or at whatever is the newest when it is asked."""
        return SinkLog(self, name, at)

    def append(self, placed: DataFrame, batch: int, limits: DataFrame | None = None, outputs: tuple[str, ...] = ("text", "jsonl"),
               next_seq: int = 0, file_bytes: int = FILE_BYTES, clustered: bool = False) -> Commit:
        """Write rows with generation and position, and commit them as the next version; see :func:`write_files`.

        ``limits`` has sink and ``max_files`` of each rule; without it everything is kept. The state is summed
        from the catalogue rows, so the log rows are read once, when they are written.
        """
        at, spark = self.commit(), self.spark
        catalog = f"catalog/{uuid.uuid4().hex}"
        write_files(placed, self.out, batch, outputs, file_bytes, clustered).write.parquet(f"{self.out}/{catalog}")
        last = F.element_at("parts", -1)
        new = spark.read.schema(FILE).parquet(f"{self.out}/{catalog}").select(  # one narrow row for each file of the batch
            "sink", "path", "pos_lo", "pos_hi", "nbytes", "generation_hi", last["text_bytes"].alias("text_bytes"),
            last["json_bytes"].alias("json_bytes")).collect()
        keep = {} if limits is None else {r["sink"]: r["max_files"] for r in limits.select("sink", "max_files").collect()}
        done = Commit(
            version=at.version + 1 if at else 0, batch=batch, catalogs=(*(at.catalogs if at else ()), catalog),
            state=_next_state(new, at.state if at else (), keep), next_seq=next_seq,
            added=tuple({k: r[k] for k in ("sink", "path", "pos_lo", "pos_hi")} for r in new))
        manifest.commit(self.out, done)
        return done

    def expire(self, before: Commit | None) -> int:
        """Delete the files that no kept segment needs any more since the version ``before``; how many.

        Tasks delete, and one that runs again finds nothing. Only sinks whose oldest segment moved are looked at.
        """
        at = self.commit()
        oldest = STATE.names.index("oldest")
        was = {row[0]: row[oldest] for row in (before.state if before else ())}
        gone = [(row[0], row[oldest], was.get(row[0], 0)) for row in at.state if row[oldest] > was.get(row[0], 0)]
        if not gone:
            return 0
        moved = self.spark.createDataFrame(gone, "sink string, now long, was long")
        rows = self.spark.read.schema(FILE).parquet(*[f"{self.out}/{c}" for c in at.catalogs])
        old = rows.join(F.broadcast(moved), "sink").where("generation_lo < now AND generation_hi >= was")
        whole = old.where("generation_hi < now").select("path")
        gone = old.select("now", "was", F.explode("parts").alias("part")).where("part.generation >= was AND part.generation < now")
        lines = gone.select(F.explode(F.array("part.text", "part.jsonl")).alias("path")).where("path IS NOT NULL")
        return self._delete(whole.unionByName(lines))

    def _delete(self, paths: DataFrame) -> int:
        out = self.out

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gone = sum(files.delete_file(f"{out}/{p}") for b in batches for p in b.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"gone": [gone]})

        tasks = 1 + paths.count() // TASK_FILES  # of names in the catalogue
        return paths.select("path").repartition(tasks, "path").mapInArrow(task, "gone long").agg(F.sum("gone")).first()[0] or 0

    def compact(self, file_bytes: int = FILE_BYTES, most: int = 10_000) -> int:
        """Merge small files that follow one another in a range of ``file_bytes`` of their log; how many files went in.

        Their rows are written again as one file with one text and one JSONL part a segment, and the new
        version names a catalogue table without the merged files and without those that expired. Positions stay, so
        followers by position notice nothing. Merged files are deleted by ``vacuum`` later, when no reader has an
        older version open. One call merges up to ``most`` files; call it again for more.
        """
        at = self.commit()
        if at is None:
            return 0
        chunk = F.floor(F.col("pos_lo") / file_bytes)
        small = self.files(at).where(F.col("nbytes") < file_bytes / 2).select("sink", "path", "pos_lo", "pos_hi", chunk.alias("chunk"))
        order = Window.partitionBy("sink").orderBy("pos_lo")  # one narrow row a file
        goes_on = (F.lag("pos_hi").over(order) == F.col("pos_lo")) & (F.lag("chunk").over(order) == F.col("chunk"))
        opened = small.withColumn("opens", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
        runs = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        many = runs.groupBy("sink", "run").agg(F.count("*").alias("files"), F.sort_array(F.collect_list("path")).alias("paths"))
        many = many.where("files > 1").orderBy("sink", "run").limit(most // 2).collect()
        paths, left = [], most
        for row in many:
            if row["files"] <= left:
                paths += row["paths"]
                left -= row["files"]
        if not paths:
            return 0
        named = materialize(self.spark.createDataFrame([(p,) for p in paths], "path string"), "merged")
        merged = self.files(at).join(F.broadcast(named), "path")  # at most ``most`` names
        old_lines = [r["path"] for r in merged.select(F.explode("parts").alias("part")).select(
            F.explode(F.array("part.text", "part.jsonl")).alias("path")).where("path IS NOT NULL").collect()]
        kept = self.state(at).select("sink", "oldest")
        rows = read_files(self.spark, self.out, paths).join(F.broadcast(kept), "sink").where("generation >= oldest")
        fresh, catalog = f"catalog/{uuid.uuid4().hex}", f"catalog/{uuid.uuid4().hex}"
        write_files(rows, self.out, at.batch, ("text", "jsonl"), file_bytes).write.parquet(f"{self.out}/{fresh}")
        rest = self.files(at).join(F.broadcast(named), "path", "left_anti").select(*FILE.names)
        rest.write.parquet(f"{self.out}/{catalog}")
        manifest.commit(self.out, replace(
            at, version=at.version + 1, catalogs=(catalog, fresh), added=(), retired=(*paths, *old_lines, *at.catalogs)))
        return len(paths)

    def vacuum(self, keep: int = 10) -> int:
        """Delete what only versions older than the newest ``keep`` need, and those versions; how many files and folders."""
        gone, found = 0, manifest.versions(self.out)
        for version in found[:len(found) - keep + 1]:  # what a version replaced is for older ones only
            for path in manifest.read_commit(self.out, version).retired:
                gone += files.delete(f"{self.out}/{path}") if path.startswith("catalog/") else files.delete_file(f"{self.out}/{path}")
        manifest.forget(self.out, keep)
        return gone


def _next_state(new: list, before: tuple[tuple, ...], keep: dict[str, int]) -> tuple[tuple, ...]:
    """Bytes in the open segment, its generation, the log's size, and the oldest segment that is kept, per sink."""
    state = {row[0]: dict(zip(STATE.names, row, strict=True)) for row in before}
    for row in sorted(new, key=lambda r: r["generation_hi"]):
        held = state.setdefault(row["sink"], dict.fromkeys(STATE.names, 0) | {"sink": row["sink"], "generation": -1})
        fresh = row["generation_hi"] > held["generation"]
        held["generation"] = row["generation_hi"]
        for name in ("text_bytes", "json_bytes"):
            held[name] = row[name] + (0 if fresh else held[name])
        held["total"] += row["nbytes"]
    for sink, held in state.items():
        if keep.get(sink):
            held["oldest"] = max(held["oldest"], held["generation"] - keep[sink], 0)
    return tuple(tuple(held.values()) for held in state.values())


class SinkLog:
    """Pages and searches of one sink. ``opened`` counts the data files that the last call read."""

    def __init__(self, store: LogStore, sink: str, at: Commit | None = None):
        self.store, self.spark, self.name, self.at, self.opened = store, store.spark, sink, at, 0

    def _files(self, flt: LogFilter | None, q: str = "", since: int = -1) -> DataFrame:
        mine = self.store.files(self.at).where(F.col("sink") == self.name)
        return mine.where(all_of(may_match(flt, q), F.col("pos_hi") > since if since >= 0 else None))

    def _read(self, found: list, condition: Column) -> DataFrame:
        self.opened += len(found)
        rows = read_files(self.spark, self.store.out, [r["path"] for r in found])
        oldest = found[0]["oldest"] if found else 0
        return rows.where((F.col("sink") == self.name) & (F.col("generation") >= oldest) & condition)

    def _page(self, chosen: DataFrame, condition: Column, count: int, newest: bool) -> DataFrame:
        """The first or last ``count`` rows, from the nearest files on; files of a sink do not overlap."""
        self.opened, got, step, edge = 0, [], FIRST_FILES, None
        order = F.desc("pos_lo") if newest else F.col("pos_lo")
        names = chosen.select("path", "pos_lo", "oldest")
        while count > len(got):
            further = names if edge is None else names.where(F.col("pos_lo") < edge if newest else F.col("pos_lo") > edge)
            found = further.orderBy(order).limit(step).collect()
            if not found:
                break
            rows = self._read(found, condition).orderBy(F.desc("pos") if newest else F.col("pos"))
            got += rows.limit(count - len(got)).collect()  # at most ``count`` rows: the page itself
            if len(found) < step:
                break
            edge, step = found[-1]["pos_lo"], step * 4
        page = self.spark.createDataFrame(sorted(got, key=lambda r: r["pos"]), LOG)
        return page

    def forward(self, pos: int, count: int = fixed.PAGE_LINES, flt: LogFilter | None = None, since: int = -1) -> DataFrame:
        """See ``paging.read_forward``."""
        start = max(pos, since)
        condition = (F.col("pos") >= start) & (flt.condition() if flt else F.lit(True))
        return self._page(self._files(flt).where(F.col("pos_hi") > start), condition, count, False)

    def after(self, pos: int, flt: LogFilter | None = None) -> DataFrame:
        """Every row from a position on that passes the filter, in no order."""
        found = self._files(flt, since=pos).select("path", "oldest").collect()
        self.opened = 0
        return self._read(found, all_of(F.col("pos") >= pos, flt.condition() if flt else None))

    def backward(self, pos: int, count: int = fixed.PAGE_LINES, flt: LogFilter | None = None, since: int = -1) -> DataFrame:
        """See ``paging.read_backward``."""
        condition = all_of(F.col("pos") < pos, from_position(since), flt.condition() if flt else None)
        return self._page(self._files(flt, since=since).where(F.col("pos_lo") < pos), condition, count, True)

    def tail(self, n: int = fixed.PAGE_LINES, flt: LogFilter | None = None, since: int = -1) -> DataFrame:
        """See ``paging.tail``."""
        condition = all_of(from_position(since), flt.condition() if flt else None)
        return self._page(self._files(flt, since=since), condition, n, True)

    def _hits(self, q: str, flt: LogFilter | None, since: int) -> Column:
        wanted = includes_any(F.col("line"), [q]) if q else None
        return all_of(from_position(since), flt.condition() if flt else None, wanted)

    def search(self, q: str, limit: int = fixed.PAGE_LINES, flt: LogFilter | None = None, since: int = -1) -> DataFrame:
        """See ``search.search``; files that cannot hold ``q`` or what the filter asks for are not opened."""
        return self._page(self._files(flt, q, since), self._hits(q, flt, since), limit, False)

    def search_count(self, q: str, flt: LogFilter | None = None, since: int = -1) -> DataFrame:
        """See ``search.search_count``."""
        found = self._files(flt, q, since).select("path", "oldest").collect()
        self.opened = 0
        return self._read(found, self._hits(q, flt, since)).agg(F.count("*").alias("total_matches"))

    def locate(self, positions: list[int]) -> DataFrame:
        """See ``positions.locate``, from the catalogue alone."""
        held = self.store.segments().where(F.col("sink") == self.name)
        asked = self.spark.createDataFrame([(p,) for p in positions], "position long")
        met = asked.join(held, F.col("start") <= F.col("position"))  # a few positions against one row a segment
        last = met.groupBy("position").agg(F.max_by(F.struct("generation", "start", "size"), "start").alias("at"))
        return last.select("position", F.col("at.generation").alias("generation"),
                           F.least(F.col("position") - F.col("at.start"), F.col("at.size")).alias("offset"))
