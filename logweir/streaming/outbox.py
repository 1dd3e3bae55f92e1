"""Delivery to targets that may fail: an outbox, a cursor per target, retries, and a table of what was given up.

What is to be sent is written once per batch and committed by one small file, whether its targets can be reached or
not. Each target then works through the batches at its own pace: its cursor moves only behind what it has taken, so a
target that fails holds up no other, and what is sent twice is at most the batch that failed in the middle.
"""

import json
import sys
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.sources import files
from logweir.sources.store import escaped

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A batch that a target has refused so often goes to the table of dead letters; targets served at a time.
ATTEMPTS, AT_ONCE = 3, 8
SENT = "target string, seq long, rcv timestamp, src string, payload binary"

#: Takes a target and its rows (``SENT``), in tasks; what it raises is a failed attempt.
Send = Callable[[str, Iterator[pa.RecordBatch]], None]


class Outbox:
    """What is waiting for the targets of forwarding rules, below one folder."""

    def __init__(self, spark: SparkSession, out: str, attempts: int = ATTEMPTS):
        self.spark, self.out, self.attempts = spark, out, attempts

    def post(self, forwards: DataFrame, batch: int) -> None:
        """Put down a batch of ``routing.forward`` rows; a batch that is run again is there already."""
        entry = f"{self.out}/batches/{batch:020d}.json"
        if files.exists(entry):
            return
        path = f"rows/{batch:012d}-{uuid.uuid4().hex}"
        forwards.write.partitionBy("target").parquet(f"{self.out}/{path}")
        files.put(entry, json.dumps({"path": path}).encode())

    def batches(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in files.names(f"{self.out}/batches") if n[0] != "_")

    def _cursor(self, target: str) -> str:
        return f"{self.out}/cursors/{escaped(target)}.json"

    def progress(self, target: str) -> dict:
        """``next``, the first batch the target has not taken, and how often that one has failed."""
        path = self._cursor(target)
        return json.loads(files.read(path)) if files.exists(path) else {"next": 0, "failed": 0}

    def waiting(self, batch: int, target: str) -> DataFrame:
        """Rows of one target in a batch; only the target's folder is read."""
        path = json.loads(files.read(f"{self.out}/batches/{batch:020d}.json"))["path"]
        return self.spark.read.schema(SENT).parquet(f"{self.out}/{path}").where(F.col("target") == target).select(
            *[c.split()[0] for c in SENT.split(", ")])

    def deliver(self, targets: list[str], send: Send) -> dict[str, str]:
        """Let every target take what is waiting for it; what kept each of those that have not caught up.

        A target stops at its first failed batch and goes on from there next time. After ``attempts`` failures the
        batch's rows go to the dead letters, with the reason, and the target goes on behind them.
        """
        with ThreadPoolExecutor(AT_ONCE) as pool:
            reasons = dict(zip(targets, pool.map(lambda t: self._serve(t, send), targets), strict=True))
        return {t: r for t, r in reasons.items() if r}

    def _serve(self, target: str, send: Send) -> str:
        at = self.progress(target)
        for batch in self.batches():
            if batch < at["next"]:
                continue
            rows, reason = self.waiting(batch, target), ""
            try:
                rows.mapInArrow(_sender(target, send), "sent long").agg(F.sum("sent")).collect()
            except PySparkException as failed:
                reason = next((x for x in reversed(str(failed).strip().split("\n")) if x.strip()), "failed").strip()
            at = {"next": batch, "failed": at["failed"] + 1} if reason else {"next": batch + 1, "failed": 0}
            if reason and at["failed"] >= self.attempts:
                dead = rows.withColumn("batch", F.lit(batch).cast("long")).withColumn("reason", F.lit(reason))
                dead.write.mode("overwrite").parquet(f"{self.out}/dead/{escaped(target)}/{batch:012d}")
                at, reason = {"next": batch + 1, "failed": 0}, ""
            files.put(self._cursor(target), json.dumps(at).encode())
            if reason:
                return reason
        return ""

    def dead_letters(self, target: str) -> DataFrame:
        """Rows that the target was given up for, with the reason."""
        folder = f"{self.out}/dead/{escaped(target)}"
        given_up = [f"{folder}/{n}" for n in files.names(folder)]
        schema = f"{SENT}, batch long, reason string"
        return self.spark.read.schema(schema).parquet(*given_up) if given_up else self.spark.createDataFrame([], schema)


def _sender(target: str, send: Send):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal count
            for batch in batches:
                count += batch.num_rows
                yield batch

        send(target, counted())
        yield pa.RecordBatch.from_pydict({"sent": [count]})

    return task
