"""WARC archives in Zstandard frames that share a dictionary, and their reader.

An archive starts with a skippable frame that holds the dictionary; every record then is a frame of its
own, so that a record can be read alone once the dictionary is known.
"""

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import arrow_map, batches_of, kept, partitions_for, rows_of, work_folder
from logweir.sources.files import file_system

# Fixed values of the WARC and Zstandard formats.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: The dictionary of an archive is built from records up to this many bytes together; its own size.
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 2 << 20, 64 << 10, 6
#: Archives with fewer records take the dictionary built from so many pages of the whole table, and so many bytes of each.
FEWEST, SHARED_PAGES, SHARED_BYTES = 16, 512, 8 << 10
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, records long, bytes long"
RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("at", pa.int64())])


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    tail = name[len("<urn:page:"):-1] if name else "none"
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit holds the HTTP header alone, whose length still tells the payload's."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        clean = url.replace("\r", "%0D").replace("\n", "%0A")
        head.append(f"WARC-Target-URI: {clean}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    else:
        block += payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, digest, type, refers_to) of a record; a response's digest is checked."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
    return _number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, kind, _number(head.get("WARC-Refers-To"))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, level: int = LEVEL,
                   sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """Every page as a record of the archives in ``folder``; returns the manifest, a row per archive.

    Equal payloads meet by their digest in a partial aggregate, so a payload of a third of all pages is no
    hot task; html is shuffled once, by page, together with narrow marks that say which pages are copies. Each task writes one archive under a name of its own and then
    moves it to its place, so that a repeated task leaves the same file. Of rows with equal page_id and payload the
    first is the response. A null html is an empty payload; a null page_id ranks last and stays null. An archive with
    few records takes a dictionary built from pages of the whole table, so that none is without.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = own.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    named = kept(long, folder + "-work", "digests")
    firsts = named.groupBy(F.col("digest").alias("same")).agg(
        F.min("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    marks = named.join(firsts, F.col("digest") == F.col("same")).select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest",
        "original", F.lit(True).alias("mark")).distinct()
    rows = own.select("*", F.lit(None).cast("long").alias("original"), F.lit(False).alias("mark")).unionByName(marks)
    order = [F.col("page_id").isNull(), F.col("page_id"), F.col("digest"), ~F.col("mark"), F.col("url")]
    ready = rows.repartition(partitions_for(pages), "page_id", "digest").sortWithinPartitions(*order)
    names = ready.columns
    shared = _shared_dictionary(own, dictionary_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, top = file_system(folder)
        system.create_dir(top, recursive=True)
        name = f"part-{task.partitionId():06d}.warc.zst"
        beside = f"{top}/.{name}.{task.taskAttemptId()}"
        count, size = 0, 0
        with system.open_output_stream(beside, compression=None) as out:
            for piece in _archive(rows_of(batches, *names), level, sample_bytes, dictionary_bytes, shared):
                out.write(piece)
                count, size = count + 1, size + len(piece)
        system.move(beside, f"{top}/{name}")
        yield from batches_of(iter([(f"{folder}/{name}", max(0, count - 1), size)]), pa.schema(
            [("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return kept(arrow_map(ready, write, MANIFEST), folder + "-manifest", "archives")


def _records(rows: Iterator[tuple]) -> Iterator[bytes]:
    """Records of sorted pages; the mark of a page's payload, if it has copies, comes before the page."""
    marked, original, first = None, None, False
    for page_id, url, payload, digest, source, mark in rows:
        if mark:
            marked, original, first = (page_id, digest), source, page_id == source
            continue
        copied = marked == (page_id, digest)
        yield record(page_id, url, payload, digest, original, copied and not first)
        first = False


def _shared_dictionary(pages: DataFrame, size: int) -> bytes:
    """A dictionary from the beginnings of the pages with the least hash of their id and payload."""
    order = [F.xxhash64("page_id", "digest"), "page_id", "digest"]
    begun = pages.select("page_id", "url", F.substring("payload", 1, SHARED_BYTES).alias("payload"), "digest")
    # The hashes alone first: each partition's least would otherwise all come to the driver with their payloads.
    least = pages.select(order[0].alias("h")).orderBy("h").limit(SHARED_PAGES).agg(F.max("h")).first()[0]
    if least is None:
        return _dictionary([], size)
    rows = begun.where(order[0] <= least).orderBy(*order).limit(SHARED_PAGES).collect()  # at most SHARED_PAGES times SHARED_BYTES
    return _dictionary([record(r["page_id"], r["url"], bytes(r["payload"]), r["digest"], None, False) for r in rows], size)


def _archive(rows: Iterator[tuple], level: int, sample_bytes: int, dictionary_bytes: int, shared: bytes = b"") -> Iterator[bytes]:
    """The frames of an archive: the dictionary of its first records, then one frame for each record."""
    import zstandard as zstd

    records, held, size = _records(rows), [], 0
    for raw in records:
        held.append(raw)
        size += len(raw)
        if size >= sample_bytes:
            break
    words = _dictionary(held, dictionary_bytes) if len(held) >= FEWEST else shared
    yield struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words
    packer = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(words) if words else None,
                                 write_content_size=True, write_checksum=True)
    for raw in held:
        yield packer.compress(raw)
    for raw in records:
        yield packer.compress(raw)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from records; where none can be trained, the records' own bytes, the last nearest."""
    import zstandard as zstd

    try:
        if len(samples) >= FEWEST:
            return zstd.train_dictionary(size, [s[: 1 << 17] for s in samples], k=256, d=8, steps=1).as_bytes()
    except zstd.ZstdError:
        pass
    return b"".join(samples)[-size:]


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every record frame of an archive, one in memory at a time."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't start with a dictionary")
    words = stream.read(size)
    opener = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(words) if words else None)
    at, rest = 8 + size, b""
    while True:
        rest = rest or stream.read(1 << 18)
        if not rest:
            return
        part, out, used = opener.decompressobj(), io.BytesIO(), 0
        while True:
            out.write(part.decompress(rest))
            used += len(rest)
            if part.eof:
                rest = part.unused_data
                used -= len(rest)
                break
            rest = stream.read(1 << 18)
            if not rest:
                raise ValueError("the archive ends inside a record")
        yield at, out.getvalue()
        at += used


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives of a manifest: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, archive and the record's offset there. Archives are streamed; every checksum is verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (path,) in rows_of(batches, "path"):
                system, place = file_system(path)
                with system.open_input_stream(place, compression=None) as stream:
                    for at, raw in frames(stream):
                        yield *parse_record(raw), path, at

        yield from batches_of(rows(), RECORD)

    spread = manifest.select("path").repartition(partitions_for(manifest), "path")
    return arrow_map(spread, read, "page_id long, url string, payload_bytes long, payload_digest string, "
                     "record_type string, refers_to long, archive string, at long")


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written to archives in a new work folder and read back."""
    return read_archives(write_archives(spark, pages, work_folder(spark, "warc")))
