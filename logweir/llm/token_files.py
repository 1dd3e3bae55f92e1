"""Token ids in flat binary files with 64-bit offsets, and their memory-mapped reader.

A part has ``ids.bin``, unsigned little-endian integers of all its documents without gaps, and
``documents.bin``, three 64-bit integers for each document: its id, whether it has one, and the offset of
its end in the part. The base of a part comes from the prefix sums of the manifest.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import arrow_map, batches_of, kept, partitions_for, rows_of, work_folder
from logweir.sources.files import file_system
from logweir.llm.word_ids import WordIds

END_ID = 2
#: Ids are gathered up to this many before they are written.
CHUNK = 1 << 20

PART = pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())])
DOCUMENT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, tokenizer: bytes, end_id: int = END_ID) -> DataFrame:
    """Every whole text encoded, closed with ``end_id`` and written in ascending doc_id order; the manifest,
    a row per part, is returned.

    Documents are range-partitioned by id (null first, equal ids by their text), and each task encodes and
    writes one part; words that a task has met before are looked up. A null text is empty and has the end id
    alone. A repeated task replaces its files by equal ones.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(partitions_for(docs), *order)
    ranged = ranged.sortWithinPartitions(*order, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = WordIds(tokenizer)
        kind = np.dtype("<u2" if max(encoder.size - 1, end_id) < 1 << 16 else "<u4")
        system, top = file_system(folder)
        name = f"part-{task.partitionId():06d}"
        beside = f"{top}/.{name}.{task.taskAttemptId()}"
        system.create_dir(beside, recursive=True)
        documents, total = 0, 0
        with system.open_output_stream(f"{beside}/ids.bin") as out, system.open_output_stream(f"{beside}/documents.bin") as index:
            for batch in batches:
                names = batch.column(0).to_pylist()
                for at in range(0, len(names), 256):  # texts are decoded few at a time
                    texts = batch.column(1).slice(at, 256).to_pylist()
                    ids, sizes = encoder.encode(texts, end_id)
                    out.write(ids.astype(kind).tobytes())
                    rows = np.empty((len(texts), 3), "<i8")
                    own = names[at:at + 256]
                    rows[:, 0] = [0 if n is None else n for n in own]
                    rows[:, 1] = [n is not None for n in own]
                    rows[:, 2] = total + np.cumsum(sizes)
                    index.write(rows.tobytes())
                    documents, total = documents + len(texts), int(rows[-1, 2])
        if documents:
            from pyarrow.fs import FileType

            if system.get_file_info(f"{top}/{name}").type != FileType.NotFound:
                system.delete_dir(f"{top}/{name}")  # what a lost attempt of this task has left
            system.move(beside, f"{top}/{name}")
            yield from batches_of(iter([(task.partitionId(), f"{folder}/{name}", documents, total, kind.itemsize)]), PART)

    return kept(arrow_map(ranged, write, "part int, path string, documents long, ids long, width int"), folder + "-manifest", "parts")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids in all earlier parts; it has one row per part."""
    rows = sorted(manifest.select("part", "ids").collect())
    bases, total = [], 0
    for part, ids in rows:
        bases.append((part, total))
        total += ids
    known = manifest.sparkSession.createDataFrame(bases, "part int, base bigint")
    return manifest.join(F.broadcast(known), "part")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids as 32-bit integers, from the files of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for path, base, width in rows_of(batches, "path", "base", "width"):
                yield from _documents(path, base, np.dtype(f"<u{width}"))

        yield from batches_of(rows(), DOCUMENT)

    spread = with_bases(manifest).select("path", "base", "width").repartition(partitions_for(manifest), "path")
    return arrow_map(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(path: str, base: int, kind: np.dtype) -> Iterator[tuple]:
    """Rows of a part; on a file system that maps files only the pages in use are in memory."""
    from pyarrow import fs

    system, place = file_system(path)
    local = isinstance(system, fs.LocalFileSystem)
    opened = pa.memory_map if local else system.open_input_file
    with opened(f"{place}/ids.bin") as ids, opened(f"{place}/documents.bin") as index:
        before, count = 0, index.size() // 24
        for at in range(0, count, 4096):
            block = np.frombuffer(index.read_at(24 * min(4096, count - at), 24 * at), "<i8").reshape(-1, 3)
            for doc_id, known, end in block.tolist():
                crc = 0
                for low in range(before, end, CHUNK):
                    high = min(end, low + CHUNK)
                    own = np.frombuffer(ids.read_at((high - low) * kind.itemsize, low * kind.itemsize), kind)
                    crc = zlib.crc32(own.astype("<u4").tobytes(), crc)
                yield (doc_id if known else None), base + before, end - before, crc
                before = end


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: bytes, end_id: int = END_ID) -> DataFrame:
    """Token files written to a new work folder and read back."""
    return read_tokens(write_tokens(docs, work_folder(spark, "tokens"), tokenizer, end_id))
