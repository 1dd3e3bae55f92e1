"""Every operator as a named query over the supplied tables."""

import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import fixed
from logweir.functions.labels import severity_label
from logweir.functions.predicates import (
    LogFilter, drop_bad_lines, facility_matches, keep_malformed, message_filter, severity_hidden,
)
from logweir.functions.text import octets, rcv_iso
from logweir.operators import paging, search as find
from logweir.operators.audit import Ledger, completeness_report
from logweir.operators.parse import PARSED_COLUMNS, parse_syslog, to_jsonl
from logweir.operators.positions import (
    locate, log_summary, relative_positions, segment_table, with_positions,
)
from logweir.operators.routing import forward, route, select_forwards
from logweir.operators.segments import assign_generations, generation_name, retain
from logweir.operators.views import detail_view, format_line, grid_view
from logweir.plans.corpus import conversation_datagrams, document_datagrams, event_datagrams
from logweir.plans.settings import (
    CONSOLE_EXCLUDE, CONSOLE_INCLUDE, FORWARD_RULES, PAGE_AT, PAGE_SINCE, POLLED, POSITIONS, RARE, ROUTES,
    STORE_FILE_BYTES,
)
from logweir.schemas import DATAGRAM, FORWARD_RULE, RECORD, ROUTE
from logweir.session import materialize, session_folder
from logweir.sources import files
from logweir.sources.chain import chain_positions, parse_jsonl, read_log_chain
from logweir.sources.datagrams import read_datagrams, spread, stream_datagrams
from logweir.sources.sinks import (
    drop_expired, read_logs, to_logs, write_jsonl, write_logs, write_text,
)
from logweir.sources.store import LogStore
from logweir.streaming.follow import LinePoll, follow, follow_log, follow_store
from logweir.streaming.ingest import (
    read_ingested, segment_batch, start_forward, start_ingest,
)
from logweir.streaming.outbox import SENT

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]

URGENT = LogFilter.of(sev="emerg,alert,crit,err")
COMBINED = LogFilter.of(
    sev="Error, WARN,notice", fac="auth,mail,LOCAL3,cron", inc=["purchase", " HOST1 "],
    exc=["value=1", ""],
)
HIT = ("seq", "pos", "line")


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, ROUTE)


def forward_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORWARD_RULES, FORWARD_RULE)


def parsed(
    spark: SparkSession, sf: str, columns: tuple[str, ...] = PARSED_COLUMNS
) -> DataFrame:
    return parse_syslog(event_datagrams(spark, sf), columns)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return to_jsonl(parsed(spark, sf)).withColumn("nbytes", octets(F.col("line")))


#: What filters and pages of a log look at.
SEARCHED = ("seq", "severity", "facility", "line", "nbytes")


def log(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """All messages as one log with positions, with the columns a query asks for."""
    return with_positions(lines(spark, sf).select(*(columns or SEARCHED)), [])


def _whole(lines: DataFrame) -> DataFrame:
    sized = lines.withColumn("nbytes", octets(F.col("line")))
    return with_positions(sized.select(*SEARCHED), [])


def document_log(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(_documents(spark, sf))


def conversation_log(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(to_jsonl(parse_syslog(conversation_datagrams(spark, sf))))


def routed_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of every sink with line and sizes."""
    messages = parse_syslog(spread(event_datagrams(spark, sf)))
    fanned = route(to_jsonl(messages), routes(spark), "write_text", "write_jsonl")
    return to_logs(fanned).drop("write_text", "write_jsonl")


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of every sink with generation and position."""
    return segment_batch(routed_logs(spark, sf), routes(spark))


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Narrow routed rows with the limits of their sink."""
    limits = routes(spark).select("sink", "max_bytes", "max_files")
    narrow = routed_logs(spark, sf).select("sink", "seq", "text_bytes", "json_bytes", "nbytes")
    return narrow.join(F.broadcast(limits), "sink")


def cut_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the exact generation."""
    return assign_generations(sizes(spark, sf), F.col("max_bytes"))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shown(df: DataFrame) -> DataFrame:
    """Parsed columns in a form both engines print alike."""
    return df.select(
        rcv_iso(F.col("rcv")).alias("rcv"), F.col("raw").cast("string").alias("raw"),
        *[c for c in PARSED_COLUMNS if c not in ("rcv", "raw")],
    )


def per_segment(logs: DataFrame) -> DataFrame:
    return logs.groupBy("sink", "generation").agg(
        F.count("*").alias("lines"), F.sum("nbytes").alias("bytes"),
        F.min("pos").alias("first_pos"), F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def urgent_messages(spark: SparkSession, sf: str) -> DataFrame:
    """ERROR or worse with the application and host that said it."""
    rows = parsed(spark, sf).filter(URGENT.condition() & F.col("app").isNotNull())
    return rows.select(
        "seq", rcv_iso(F.col("rcv")).alias("rcv"), "severity", "hostname", "app", "message"
    )


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return to_jsonl(parse_syslog(document_datagrams(spark, sf)))


def _jsonl_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "jsonl")
    write_jsonl(lines(spark, sf).withColumn("sink", F.lit("main")), path)
    text = spark.read.option("lineSep", "\n").text(path)
    return parse_jsonl(text.select(F.col("value").alias("line"))).select("line", *RECORD.names)


def _text_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "text")
    written = routed_logs(spark, sf).filter("text_bytes > 0")  # sinks that write text
    write_text(written.select("sink", "seq", "raw"), path)
    return spark.read.option("lineSep", "\n").text(path).select("sink", F.col("value").alias("raw"))


def _stored(spark: SparkSession, sf: str) -> str:
    path = f"{new_folder(spark, 'stored')}/logs"
    write_logs(segmented(spark, sf), path, clustered=True)
    return path


_made: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf: str, name: str, make: Callable[[SparkSession, str], str]) -> str:
    """A folder that queries of one session share, made from the given tables when it is first asked for."""
    key = (spark.conf.get("spark.app.id", ""), sf, name)
    if key not in _made or not files.exists(_made[key]):
        _made[key] = make(spark, sf)
    return _made[key]


def new_store(spark: SparkSession, sf: str) -> str:
    """A log store with all messages of every sink."""
    out = new_folder(spark, "store")
    LogStore(spark, out).append(segmented(spark, sf), 0, file_bytes=STORE_FILE_BYTES, clustered=True)
    return out


def store(spark: SparkSession, sf: str) -> LogStore:
    return LogStore(spark, _once(spark, sf, "store", new_store))


def _main(spark: SparkSession, sf: str):
    return store(spark, sf).sink("main")


def _compacted(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of ingest after small files were merged and the merged ones deleted."""
    held = LogStore(spark, new_ingest(spark, sf))
    held.compact()
    held.vacuum(1)
    return per_segment(held.rows())


def _poll_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A sink read poll by poll until a poll has caught up."""
    poll = LinePoll(store(spark, sf), POLLED, f"poll-{uuid.uuid4().hex}")
    rows, full = poll.full_polls(fixed.POLL_LINES, ("seq", "pos"))
    return rows.unionByName(poll.poll(fixed.POLL_LINES).select(F.lit(full).alias("poll"), "seq", "pos"))


def _expired_dropped(spark: SparkSession, sf: str) -> DataFrame:
    path = _stored(spark, sf)
    drop_expired(spark, path, routes(spark))
    return read_logs(spark, path).groupBy("sink", "generation").agg(F.count("*").alias("lines"))


def _chain(spark: SparkSession, sf: str, max_files: int) -> DataFrame:
    """All segments of one sink exported as rotated files and read back as one log with positions."""
    folder = new_folder(spark, "chain")
    main = generation_name(segmented(spark, sf).filter("sink = 'main'"))
    rows = materialize(main.select("seq", "age", "line"), "chain-rows")
    _export_chain(rows, folder, "syslog", ".jsonl")
    return chain_positions(read_log_chain(spark, f"{folder}/syslog.jsonl", max_files))


def _chain_log(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain parsed, ready for pages and search."""
    return parse_jsonl(_chain(spark, sf, 0))


def _export_chain(rows: DataFrame, folder: str, stem: str, ext: str) -> None:
    """One file per age, named as a rotating writer names them (at most one segment per task)."""
    staging = f"{folder}-staging"
    (
        rows.repartition("age").sortWithinPartitions("age", "seq")
        .select("age", F.col("line").alias("value")).write.partitionBy("age").text(staging)
    )
    for part in files.names(staging):
        if part.startswith("age="):
            age = int(part.removeprefix("age="))
            name = f"{stem}{ext}" if age == 0 else f"{stem}.{age}{ext}"
            for file in files.names(f"{staging}/{part}"):
                if file.startswith("part-"):
                    files.move_file(f"{staging}/{part}/{file}", f"{folder}/{name}")


BATCHES, LANDING_ROWS = 4, 1_000_000


def _landed(spark: SparkSession, sf: str) -> str:
    """Datagrams as landing files of bounded size that appear one after another, in arrival order."""
    path = new_folder(spark, "landing")
    parts = max(BATCHES, event_datagrams(spark, sf).count() // LANDING_ROWS)
    event_datagrams(spark, sf).repartitionByRange(parts, "seq").write.parquet(f"{path}-sorted")
    for name in sorted(n for n in files.names(f"{path}-sorted") if n.startswith("part-")):
        part = spark.read.schema(DATAGRAM).parquet(f"{path}-sorted/{name}")
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def landed(spark: SparkSession, sf: str) -> str:
    return _once(spark, sf, "landing", _landed)


def _landing_stream(spark: SparkSession, sf: str, numbered: bool = True) -> DataFrame:
    """The landing files as a stream in about as many micro-batches as BATCHES."""
    path = landed(spark, sf)
    count = sum(n.startswith("part-") for n in files.names(path))
    return stream_datagrams(spark, path, max(1, count // BATCHES), numbered)


def new_ingest(spark: SparkSession, sf: str, numbered: bool = True) -> str:
    """Where the landed datagrams were ingested, one landing file per micro-batch."""
    out = new_folder(spark, "ingest")
    stream = _landing_stream(spark, sf, numbered)
    start_ingest(stream, routes(spark), out, f"{out}/checkpoint").awaitTermination()
    return out


def ingested(spark: SparkSession, sf: str) -> LogStore:
    return LogStore(spark, _once(spark, sf, "ingest", new_ingest))


def _ingest_retained(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that are still there after ingest: in the catalogue, and in the log itself."""
    held = ingested(spark, sf)
    kept = held.segments().select("sink", "generation", "lines")
    there = held.rows().groupBy("sink", "generation").agg(F.count("*").alias("stored_lines"))
    return kept.join(there, ["sink", "generation"], "full").select("sink", "generation", "lines", "stored_lines")


def _ingest_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """The same datagrams from a source without numbers."""
    return per_segment(read_ingested(spark, new_ingest(spark, sf, False)))


def _stream_forward(spark: SparkSession, sf: str) -> DataFrame:
    out = new_folder(spark, "forward")
    start_forward(_landing_stream(spark, sf), forward_rules(spark), f"{out}/sent", f"{out}/checkpoint").awaitTermination()
    sent = spark.read.parquet(f"{out}/sent")
    return sent.select("target", "seq", F.col("payload").cast("string").alias("payload"))


def _to_files(folder: str):
    """A sender that writes what it is given to files of its target."""
    def send(target: str, batches: Iterator[pa.RecordBatch]) -> None:
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                pq.write_table(pa.Table.from_batches([batch]), sink)
                files.put(f"{folder}/{target}-{uuid.uuid4().hex}.parquet", sink.getvalue().to_pybytes())

    return send


def _forward_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """What the targets took out of the outbox, each by itself."""
    out = new_folder(spark, "outbox")
    start_forward(
        _landing_stream(spark, sf), forward_rules(spark), out, f"{out}/checkpoint", send=_to_files(f"{out}/sent")
    ).awaitTermination()
    sent = spark.read.schema(SENT).parquet(f"{out}/sent")
    return sent.select("target", "seq", F.col("payload").cast("string").alias("payload"))


def _shown(spark: SparkSession, rows: DataFrame, out: str, schema: str) -> DataFrame:
    """What a stream of rows shows until it has caught up."""
    rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option(
        "path", f"{out}/shown").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/shown")


def _stream_follow(spark: SparkSession, sf: str) -> DataFrame:
    out = new_folder(spark, "follow")
    write_jsonl(lines(spark, sf).withColumn("sink", F.lit("main")), f"{out}/lines")
    # Files are capped per poll; the lines of all polls together are compared.
    rows = follow(follow_log(spark, f"{out}/lines", 1), None, CONSOLE_INCLUDE, CONSOLE_EXCLUDE)
    return _shown(spark, rows.select("text"), out, "text string")


def _stream_follow_sink(spark: SparkSession, sf: str) -> DataFrame:
    """One sink of what ingest wrote, the segments that retention keeps."""
    held, out = ingested(spark, sf), new_folder(spark, "follow-sink")
    kept = held.state().filter("sink = 'jobs'").select("oldest")
    rows = follow_store(spark, held.out, "jobs").join(F.broadcast(kept), F.col("generation") >= F.col("oldest"))
    return _shown(spark, rows.select("line"), out, "line string")


def _follow_from_end(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that come after half of the log, followed without history."""
    held, out = store(spark, sf), new_folder(spark, "follow-end")
    total = held.state().filter("sink = 'main'").select("total").first()
    rows = follow_store(spark, held.out, "main", total[0] // 2 if total else 0)
    return _shown(spark, rows.select(*HIT), out, "seq long, pos long, line string")


def _received(spark: SparkSession, sf: str) -> tuple[int, int]:
    """First and last number handed out at arrival."""
    ends = event_datagrams(spark, sf).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    return ends.lo, ends.hi


def _context(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf)
    hit = find.search(rows, "value=2", 1).select("pos").first()
    return paging.context_window(rows, hit.pos if hit else 0).select(*HIT)


def _console(spark: SparkSession, sf: str):
    return message_filter(CONSOLE_INCLUDE, CONSOLE_EXCLUDE)


def _completeness_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed messages in four batches that each hold some copies of a message, the second one delivered twice."""
    rows = materialize(route(parsed(spark, sf_dir, ("seq", "facility_code")), routes(spark)).select("seq", "sink"), "routed-numbers")
    ledger = Ledger(spark, f"{session_folder(spark)}/ledger-{uuid.uuid4().hex}")
    for batch in (0, 1, 1, 2, 3):
        ledger.add(rows.where(F.pmod(F.xxhash64("seq", "sink"), F.lit(4)) == batch), batch)
    return ledger.report()


def queries() -> dict[str, Query]:
    """Query name to a function of the session and the table folder."""
    q: dict[str, Query] = {}

    # Parse and record
    q["parse_all"] = lambda s, sf: shown(parsed(s, sf))
    q["parse_documents"] = lambda s, sf: shown(parse_syslog(document_datagrams(s, sf)))
    q["parse_conversations"] = lambda s, sf: shown(parse_syslog(conversation_datagrams(s, sf)))
    q["repair_latin1"] = lambda s, sf: to_jsonl(
        parse_syslog(document_datagrams(s, sf, "ISO-8859-1"))
    ).select("seq", "app", "message", octets(F.col("line")).alias("nbytes"))
    q["pri_decode"] = lambda s, sf: parsed(
        s, sf, ("seq", "pri", "facility_code", "severity_code", "facility", "severity")
    )
    q["proto_counts"] = lambda s, sf: parsed(s, sf, ("proto",)).groupBy("proto").agg(F.count("*").alias("n"))
    q["urgent_messages"] = urgent_messages
    q["jsonl_lines"] = lambda s, sf: lines(s, sf).select("seq", "line")
    q["jsonl_documents"] = lambda s, sf: _documents(s, sf).select(
        "seq", "line", octets(F.col("line")).alias("nbytes")
    )
    q["jsonl_round_trip"] = lambda s, sf: parse_jsonl(lines(s, sf).select("seq", "line")).select(
        "seq", *RECORD.names
    )

    # Routing and forwarding
    header = ("seq", "proto", "facility_code", "facility")
    q["route_fanout"] = lambda s, sf: route(parsed(s, sf, header), routes(s)).select(
        "sink", "seq", "proto", "facility"
    )
    q["route_counts"] = lambda s, sf: route(
        parsed(s, sf, ("seq", "facility_code")), routes(s)
    ).groupBy("sink").agg(F.count("*").alias("n"))
    q["select_forwards"] = lambda s, sf: select_forwards(
        parsed(s, sf, header), forward_rules(s)
    ).select("target", "seq", "proto", "facility")
    outgoing = ("seq", "rcv", "src", "raw", "facility_code")
    q["forward_truncated"] = lambda s, sf: forward(parsed(s, sf, outgoing), forward_rules(s)).select(
        "target", "seq", F.col("payload").cast("string").alias("payload"),
        F.octet_length("payload").alias("size"),
    )

    # Filters
    def filtered(condition, *columns):
        return lambda s, sf: log(s, sf).filter(condition()).select(*(columns or HIT))

    q["filter_sev"] = filtered(lambda: LogFilter.of(sev="error,Warn").condition())
    q["filter_fac"] = filtered(lambda: LogFilter.of(fac="auth, CRON").condition())
    q["filter_fac_codes"] = lambda s, sf: parsed(s, sf, ("seq", "facility_code")).filter(
        facility_matches([4, 15])
    )
    q["filter_inc_exc"] = filtered(
        lambda: LogFilter.of(inc=["SignUp", "host7"], exc=["value=1"]).condition()
    )
    q["filter_combined"] = filtered(COMBINED.condition)
    q["filter_raw_lines"] = lambda s, sf: lines(s, sf).select("seq", "line").filter(
        COMBINED.line_condition()
    )
    q["filter_message"] = lambda s, sf: parsed(s, sf, ("seq", "message")).filter(_console(s, sf))
    q["hide_sev"] = filtered(lambda: severity_hidden(["debug", "INFO", "emerg"]))
    q["keep_malformed"] = lambda s, sf: parsed(s, sf, ("seq", "proto")).filter(
        keep_malformed(False)
    )
    q["drop_bad_lines"] = lambda s, sf: parsed(s, sf, ("seq", "raw")).select(
        "seq", F.col("raw").cast("string").alias("line")
    ).filter(drop_bad_lines("line", json_only=True))

    # Positions and pages
    q["positions"] = lambda s, sf: log(s, sf, "seq", "nbytes").select("seq", "nbytes", "pos")
    q["positions_documents"] = lambda s, sf: document_log(s, sf).select("seq", "nbytes", "pos")
    q["positions_by_sink"] = lambda s, sf: with_positions(routed_logs(s, sf).select("sink", "seq", "nbytes"))
    q["log_summary"] = lambda s, sf: log_summary(lines(s, sf))
    q["locate"] = lambda s, sf: locate(
        with_positions(cut_sizes(s, sf).filter("sink = 'main'")), list(POSITIONS)
    )
    q["page_forward"] = lambda s, sf: paging.read_forward(
        log(s, sf), PAGE_AT, 20, COMBINED
    ).select(*HIT)
    q["page_forward_summary"] = lambda s, sf: paging.forward_summary(
        log(s, sf), PAGE_AT, 20, COMBINED
    )
    q["page_backward"] = lambda s, sf: paging.read_backward(
        log(s, sf), PAGE_AT, 50, URGENT
    ).select(*HIT)
    q["page_backward_summary"] = lambda s, sf: paging.backward_summary(
        log(s, sf), PAGE_AT, 50, URGENT
    )
    q["tail_n"] = lambda s, sf: paging.tail(log(s, sf)).select(*HIT)
    q["tail_filtered"] = lambda s, sf: paging.tail(log(s, sf), flt=URGENT).select(*HIT)
    q["tail_console"] = lambda s, sf: format_line(
        paging.tail(log(s, sf, *PARSED_COLUMNS, "nbytes"), fixed.TAIL_LINES, _console(s, sf))
    ).select("text")
    q["since_page"] = lambda s, sf: paging.tail(log(s, sf), since=PAGE_SINCE).select(*HIT)
    q["context"] = _context
    q["show_all"] = lambda s, sf: format_line(
        paging.show_all(log(s, sf, *PARSED_COLUMNS, "nbytes"), _console(s, sf))
    ).select("pos", "text")
    q["latest_rows"] = lambda s, sf: paging.latest_rows(
        log(s, sf).filter(LogFilter.of(inc=["value=2"]).condition())
    ).select(*HIT)

    # Search and facets
    q["search_hits"] = lambda s, sf: find.search(log(s, sf), "VALUE=2", 200, URGENT).select(*HIT)
    q["search_total"] = lambda s, sf: find.search_count(lines(s, sf), "VALUE=2", URGENT)
    q["search_numbered"] = lambda s, sf: find.search_numbered(log(s, sf), "value=2").select(
        "seq", "pos", "k", "shown", "total_matches", "counter", "next_k", "prev_k"
    )
    q["search_documents"] = lambda s, sf: find.search(document_log(s, sf), "License").select(
        "seq", "pos"
    )
    q["search_documents_total"] = lambda s, sf: find.search_count(_documents(s, sf), "License")
    q["search_conversations_total"] = lambda s, sf: find.search_count(
        conversation_log(s, sf), "data", since=10_000
    )
    q["facility_facet"] = lambda s, sf: find.facet(parsed(s, sf, ("facility",)), counts=True)
    q["facility_labels"] = lambda s, sf: find.facet(parsed(s, sf, ("facility",)))
    q["severity_counts"] = lambda s, sf: find.facet(
        parsed(s, sf, ("severity",)), severity_label(F.col("severity")), counts=True
    )

    # Segments and stored logs
    q["segments_exact"] = lambda s, sf: cut_sizes(s, sf).select("sink", "seq", "generation")
    q["segment_table"] = lambda s, sf: segment_table(with_positions(cut_sizes(s, sf)), ["sink"])
    q["segment_ages"] = lambda s, sf: generation_name(cut_sizes(s, sf)).select("sink", "seq", "age")
    q["retained"] = lambda s, sf: retain(cut_sizes(s, sf), F.col("max_files")).select(
        "sink", "seq", "generation"
    )
    q["retained_positions"] = lambda s, sf: relative_positions(
        retain(with_positions(cut_sizes(s, sf)), F.col("max_files"))
    ).select("sink", "seq", "rel_pos")
    q["stored_table"] = lambda s, sf: per_segment(LogStore(s, new_store(s, sf)).rows())
    q["stored_tail"] = lambda s, sf: _main(s, sf).tail(100, URGENT).select(*HIT)
    q["stored_page"] = lambda s, sf: _main(s, sf).forward(PAGE_AT, 100, URGENT).select(*HIT)
    q["stored_backward"] = lambda s, sf: _main(s, sf).backward(PAGE_AT, 50, URGENT).select(*HIT)
    q["stored_since"] = lambda s, sf: _main(s, sf).tail(since=PAGE_SINCE).select(*HIT)
    q["stored_search"] = lambda s, sf: _main(s, sf).search("VALUE=2", 200, URGENT).select(*HIT)
    q["stored_search_total"] = lambda s, sf: _main(s, sf).search_count("VALUE=2", URGENT)
    q["stored_rare"] = lambda s, sf: _main(s, sf).search(RARE).select(*HIT)
    q["stored_locate"] = lambda s, sf: _main(s, sf).locate(list(POSITIONS))
    q["stored_facet"] = lambda s, sf: store(s, sf).facility_facet("main")
    q["stored_segments"] = lambda s, sf: store(s, sf).segments()
    q["poll_lines"] = _poll_lines
    q["expired_dropped"] = _expired_dropped
    chain_columns = ("age", "pos", "nbytes", "line")
    q["log_chain"] = lambda s, sf: _chain(s, sf, 10).select(*chain_columns)
    q["log_chain_all"] = lambda s, sf: _chain(s, sf, 0).select(*chain_columns)
    q["chain_page"] = lambda s, sf: paging.read_forward(
        _chain_log(s, sf), PAGE_AT, 20, COMBINED
    ).select("pos", "line")
    q["chain_tail"] = lambda s, sf: paging.tail(_chain_log(s, sf), flt=URGENT).select("pos", "line")
    q["chain_search"] = lambda s, sf: find.search(
        _chain_log(s, sf), "VALUE=2", 200, URGENT
    ).select("pos", "line")
    q["chain_search_total"] = lambda s, sf: find.search_count(_chain_log(s, sf), "VALUE=2", URGENT)
    q["jsonl_sink"] = _jsonl_sink
    q["text_sink"] = _text_sink

    # Views
    q["format_line"] = lambda s, sf: format_line(parsed(s, sf)).select("seq", "text")
    q["format_line_columns"] = lambda s, sf: format_line(
        parsed(s, sf), ("message", "rcv", "src", "proto", "msg_time", "msgid", "nothing"), "time"
    ).select("seq", "text")
    q["grid_view"] = lambda s, sf: grid_view(parsed(s, sf), keep=("seq",))
    q["grid_view_local"] = lambda s, sf: grid_view(
        parsed(s, sf), hidden=(), tz="Asia/Tokyo", keep=("seq",)
    )
    q["detail_view"] = lambda s, sf: detail_view(parsed(s, sf))

    # Streams and audits
    q["landed_datagrams"] = lambda s, sf: read_datagrams(s, landed(s, sf)).select(
        "seq", rcv_iso(F.col("rcv")).alias("rcv"), "src", F.col("payload").cast("string").alias("payload")
    )
    q["stream_ingest"] = lambda s, sf: per_segment(read_ingested(s, new_ingest(s, sf)))
    q["ingest_text"] = lambda s, sf: ingested(s, sf).lines("text")
    q["ingest_jsonl"] = lambda s, sf: ingested(s, sf).lines("jsonl")
    q["ingest_retained"] = _ingest_retained
    q["ingest_compacted"] = _compacted
    q["ingest_arrivals"] = _ingest_arrivals
    q["ingest_facets"] = lambda s, sf: ingested(s, sf).facets("severity")
    q["ingest_summary"] = lambda s, sf: ingested(s, sf).summary()
    q["stream_forward"] = _stream_forward
    q["forward_outbox"] = _forward_outbox
    q["stream_follow"] = _stream_follow
    q["stream_follow_sink"] = _stream_follow_sink
    q["follow_from_end"] = _follow_from_end
    q["completeness"] = lambda s, sf: completeness_report(
        parsed(s, sf, ("seq", "proto")).filter(keep_malformed(False)), "seq", *_received(s, sf)
    )
    q["completeness_fanout"] = lambda s, sf: completeness_report(
        route(parsed(s, sf, ("seq", "facility_code")), routes(s)), "seq", *_received(s, sf)
    )
    q["completeness_batches"] = _completeness_batches
    return q
