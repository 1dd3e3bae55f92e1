"""Completeness of a numbered log: which numbers are missing or occur more than once."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.sources import files

#: Numbers of one block; an interval lies within a block, so no window sees more rows than that and the new ones.
BLOCK = 1 << 16


def completeness_report(
    rows: DataFrame, key: str = "seq", lo: int | None = None, hi: int | None = None
) -> DataFrame:
    """(key, copies) for every number in ``lo..hi`` that does not occur exactly once.

    Expected and found numbers are counted together: one shuffle, combined before it, so many
    copies of one number cost nothing extra. The bounds default to the smallest and largest number.
    """
    if lo is None or hi is None:
        found = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        lo = found.lo if lo is None else lo
        hi = found.hi if hi is None else hi
        if lo is None or hi is None:
            return rows.select(F.col(key), F.lit(0).cast("long").alias("copies")).limit(0)
    expected = rows.sparkSession.range(lo, hi + 1).select(
        F.col("id").alias(key), F.lit(0).cast("long").alias("copies")
    )
    present = rows.filter(F.col(key).between(lo, hi)).select(
        F.col(key).cast("long").alias(key), F.lit(1).cast("long").alias("copies")
    )
    counted = expected.unionByName(present).groupBy(key).agg(F.sum("copies").alias("copies"))
    return counted.filter("copies != 1")


def islands(counted: DataFrame) -> DataFrame:
    """(block, lo, hi): the runs of consecutive numbers in rows (block, lo, hi) of intervals that do not overlap."""
    order = Window.partitionBy("block").orderBy("lo")
    fresh = F.coalesce(F.col("lo") > F.lag("hi").over(order) + 1, F.lit(True))
    runs = counted.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("block", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


class Ledger:
    """Which numbers a growing log has held: intervals of consecutive numbers, and how often others were repeated.

    Batches are added one after another, each under its number, and one that is added again changes nothing. What is
    kept is a row per gap, per block of 65,536 numbers and per repeated number, so adding and reporting follow the
    gaps and not the length of the log. Null numbers count for nothing; numbers are whole and not negative.
    """

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in files.names(f"{self.out}/batches") if n.endswith(".json") and n[0] != "_")

    def _tables(self, version: int | None) -> tuple[DataFrame, DataFrame]:
        """The intervals and the repeats of a version; empty ones before the first."""
        schemas = "block long, lo long, hi long", "number long, more long"
        if version is None:
            return tuple(self.spark.createDataFrame([], s) for s in schemas)
        folder = json.loads(files.read(self._marker(version)))["tables"]
        return tuple(self.spark.read.schema(s).parquet(f"{folder}/{n}") for s, n in zip(schemas, ("islands", "repeats"), strict=True))

    def _marker(self, batch: int) -> str:
        return f"{self.out}/batches/{batch:020d}.json"

    def add(self, rows: DataFrame, batch: int, key: str = "seq") -> None:
        """Merge the numbers of a batch into the intervals. Copies are counted before anything is shuffled on."""
        done = self._versions()
        if done and batch <= done[-1]:
            return
        held, repeats = self._tables(done[-1] if done else None)
        number = F.col(key).cast("long")
        new = rows.where(number.isNotNull()).groupBy(number.alias("lo")).agg(F.count(F.lit(1)).alias("n"))
        new = new.select(F.floor(F.col("lo") / BLOCK).alias("block"), "lo", F.col("lo").alias("hi"), "n")
        both = held.withColumn("n", F.lit(0).cast("long")).unionByName(new)
        # A new number is known where an interval from before begins at or below it and ends at or above it.
        before = Window.partitionBy("block").orderBy("lo", "n")
        reach = F.max(F.when(F.col("n") == 0, F.col("hi"))).over(before)
        folder = f"{self.out}/tables/{uuid.uuid4().hex}"
        both.withColumn("known", (F.col("n") > 0) & F.coalesce(reach >= F.col("lo"), F.lit(False))).write.parquet(f"{folder}/marked")
        marked = self.spark.read.parquet(f"{folder}/marked")
        islands(marked.where("NOT known").select("block", "lo", "hi")).write.parquet(f"{folder}/islands")
        more = F.col("n") - F.when(F.col("known"), 0).otherwise(1)
        again = marked.where("n > 0").select(F.col("lo").alias("number"), more.alias("more")).where("more > 0")
        repeats.unionByName(again).groupBy("number").agg(F.sum("more").alias("more")).write.parquet(f"{folder}/repeats")
        files.delete(f"{folder}/marked")
        files.put(self._marker(batch), json.dumps({"tables": folder}).encode())

    def report(self, key: str = "seq") -> DataFrame:
        """(key, copies) for every number from the least to the largest that does not occur exactly once.

        Gaps inside blocks come from the intervals; only blocks without any number are looked for in the range.
        """
        done = self._versions()
        held, repeats = self._tables(done[-1] if done else None)
        found = held.agg(F.min("lo").alias("first"), F.max("hi").alias("last")).first()
        first, last = (0, -1) if found[0] is None else found
        order = Window.partitionBy("block").orderBy("lo")
        low, high = F.col("block") * BLOCK, (F.col("block") + 1) * BLOCK - 1
        gaps = held.select(
            F.coalesce(F.lag("hi").over(order) + 1, F.greatest(low, F.lit(first))).alias("a"), (F.col("lo") - 1).alias("b"),
            F.when(F.lead("lo").over(order).isNull(), F.col("hi") + 1).alias("c"), F.least(high, F.lit(last)).alias("d"))
        inner = gaps.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("c").alias("a"), F.col("d").alias("b")))).alias("g"))
        blocks = self.spark.range(first // BLOCK, last // BLOCK + 1).withColumnRenamed("id", "block")
        empty = blocks.join(held.select("block").distinct(), "block", "left_anti").select(F.struct(low.alias("a"), high.alias("b")).alias("g"))
        holes = inner.unionByName(empty).select("g.a", "g.b").where("a <= b")
        missing = holes.select(F.explode(F.sequence("a", "b")).alias(key), F.lit(0).cast("long").alias("copies"))
        return missing.unionByName(repeats.select(F.col("number").alias(key), (F.col("more") + 1).alias("copies")))
