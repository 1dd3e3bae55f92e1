"""Continuous parse, route, write and expire, and continuous forwarding.

A micro-batch writes files of its own and then one small commit (see ``sources.manifest``), so readers see it
whole or not at all and nothing is renamed; a batch that is run again after a failure finds its commit and does
nothing. The state it continues from (bytes and generation per sink, arrival numbers handed out) is part of the
commit before; nothing is held in one task or on the driver.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweir.operators.arrival import number_arrivals
from logweir.operators.parse import parse_syslog, to_jsonl
from logweir.operators.routing import Router, forward
from logweir.operators.segments import assign_generations
from logweir.session import materialize, scratch_scope
from logweir.sources.datagrams import spread
from logweir.sources.sinks import deliver, to_logs
from logweir.sources.store import LogStore
from logweir.streaming.outbox import Outbox, Send

#: Small files are merged after so many batches.
COMPACT_EVERY = 64
#: Columns of a rule that say which outputs its sink writes.
OUTPUTS = ("write_text", "write_jsonl")


def segment_batch(
    logs: DataFrame, routes: DataFrame, before: DataFrame | None = None
) -> DataFrame:
    """Add ``generation`` and ``pos`` to one batch of log rows, going on from the state before it."""
    # Routing rules and state have one row per sink.
    limited = logs.join(
        F.broadcast(routes.select("sink", F.col("max_bytes").alias("_limit"))), "sink"
    )
    carry = None if before is None else before.select("sink", "text_bytes", "json_bytes", "generation")
    placed = assign_generations(
        limited, F.col("_limit"), carry, sums={"pos": "nbytes"}
    )
    if before is None:
        return placed.drop("_limit")
    base = before.select("sink", F.col("total").alias("_base"), F.col("generation").alias("_open"))
    return placed.join(F.broadcast(base), "sink", "left").withColumn(
        "pos", F.col("pos") + F.coalesce("_base", F.lit(0))
    ).withColumn(
        # An endless segment keeps the number it has.
        "generation", F.greatest("generation", F.coalesce("_open", F.lit(0)))
    ).drop("_limit", "_base", "_open")


def write_batch(
    datagrams: DataFrame, batch: int, routes: DataFrame, out: str, text: bool = True,
    jsonl: bool = True, compact_every: int = COMPACT_EVERY, router: Router | None = None,
) -> None:
    """Parse, route, segment, write, commit and expire one batch.

    A sink's text and JSONL are written where its rule says so; ``text`` and ``jsonl`` switch an output
    off for all sinks. Datagrams without ``seq`` get arrival numbers that go on from the batch before.
    """
    store = LogStore(datagrams.sparkSession, out)
    at = store.commit()
    if at is not None and at.batch >= batch:
        return  # an earlier run of this batch has committed it
    with scratch_scope(datagrams.sparkSession):
        _write_batch(store, datagrams, batch, routes, text, jsonl, router or Router(routes, *OUTPUTS))
        if (batch + 1) % compact_every == 0:
            store.compact()
            store.vacuum()


def _write_batch(
    store: LogStore, datagrams: DataFrame, batch: int, routes: DataFrame, text: bool, jsonl: bool, router: Router,
) -> None:
    at = store.commit()
    numbered, next_seq = number_arrivals(datagrams, at.next_seq if at else 0)
    numbered = spread(numbered)
    # The line is built once per message, before the fan-out; the outputs come with the rule.
    logs = to_logs(router(to_jsonl(parse_syslog(numbered)))).drop(*OUTPUTS)
    placed = segment_batch(logs, routes, store.state(at))
    outputs = tuple(name for name, on in (("text", text), ("jsonl", jsonl)) if on)
    store.append(placed, batch, routes.select("sink", "max_files"), outputs, next_seq, clustered=True)
    store.expire(at)


def read_segments(spark: SparkSession, out: str) -> DataFrame:
    """Start, size and line count of every segment that is kept, from the catalogue."""
    return LogStore(spark, out).segments()


def start_ingest(
    stream: DataFrame, routes: DataFrame, out: str, checkpoint: str,
    trigger: dict | None = None, text: bool = True, jsonl: bool = True,
) -> StreamingQuery:
    """Datagrams to a log store below ``out`` as they arrive: data files, and text and JSONL for the sinks
    whose rules name them, old segments going as ``max_files`` says."""
    router = Router(routes, *OUTPUTS)
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda df, batch: write_batch(df, batch, routes, out, text, jsonl, router=router))
        .start()
    )


def read_ingested(spark: SparkSession, out: str) -> DataFrame:
    """All log rows that are kept."""
    return LogStore(spark, out).rows()


def start_forward(
    stream: DataFrame, rules: DataFrame, out: str, checkpoint: str, trigger: dict | None = None,
    send: Send | None = None,
) -> StreamingQuery:
    """Truncated payloads per target, with a checkpoint of its own, so that ingest goes on whatever happens here.

    Without ``send`` the payloads are written to a folder per target. With it they go to an outbox below ``out``,
    from which each target takes them at its own pace (see ``streaming.outbox``): one that fails stops no other.
    """
    outbox = Outbox(stream.sparkSession, out)
    targets = [r["target"] for r in rules.filter("enabled").select("target").distinct().collect()] if send else []

    def forwarded(df: DataFrame, batch: int) -> None:
        rows = forward(parse_syslog(df), rules)
        if send is None:
            deliver(rows, f"{out}/batch={batch}")
            return
        outbox.post(rows, batch)
        outbox.deliver(targets, send)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(forwarded).start()
    )
