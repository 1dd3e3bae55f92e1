"""Rotated JSONL files ``stem.N.ext … stem.1.ext, stem.ext`` as one log, oldest first."""

import posixpath
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.functions.predicates import drop_bad_lines
from logweir.schemas import RECORD

CHAIN_SCHEMA = (
    "line string, age bigint, file_size bigint, block_start bigint, line_id bigint"
)


def _glob_escape(text: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", text)


def read_log_chain(spark: SparkSession, base_path: str, max_files: int = 10) -> DataFrame:
    """Lines of the active file (``age`` 0) and its newest ``max_files`` rotated ones; 0 is all.

    Rotated files are ``stem.N.ext`` with N from 1 to the largest 64-bit number and no leading zero; other
    names are no part of the log. Missing and empty files simply contribute nothing. ``block_start`` and ``line_id`` order the
    lines inside a file; lines end at a newline only, so a carriage return stays in the line.
    """
    folder, name = posixpath.split(base_path)
    stem, ext = posixpath.splitext(name)
    pattern = f"{_glob_escape(stem)}{{,.*}}{_glob_escape(ext)}"
    try:
        text = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(folder)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
            raise
        return spark.createDataFrame([], CHAIN_SCHEMA)
    file_name = F.col("_metadata.file_name")
    number = F.regexp_extract(
        file_name, rf"\A{re.escape(stem)}\.([1-9][0-9]{{0,18}}){re.escape(ext)}\z", 1
    )
    age = F.when(file_name == name, F.lit(0).cast("long")).when(number != "", number.try_cast("long"))
    within = age.isNotNull() & (age <= max_files) if max_files > 0 else age.isNotNull()
    # Files are chosen by name before lines are numbered, so that no other file is opened.
    return text.filter(within).select(
        F.col("value").alias("line"), age.alias("age"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
    )


def chain_positions(chain: DataFrame) -> DataFrame:
    """(generation, age, pos, nbytes, line) of a chain, blank lines counted and then dropped.

    ``pos`` is the byte at which the line starts, 0 being the first byte of the oldest file. Bytes
    are summed inside one input split, splits inside one file, files inside the chain; the biggest
    window is one split.
    """
    split = ["age", "block_start"]
    sized = chain.withColumn("_full", F.octet_length("line").cast("long") + 1)
    inside = Window.partitionBy(*split).orderBy("line_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = sized.groupBy(*split).agg(
        F.sum("_full").alias("_bytes"), F.first("file_size").alias("file_size")
    )
    earlier = Window.partitionBy("age").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    splits = totals.withColumn("_split", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)))
    # One row per file of the chain.
    files = totals.groupBy("age").agg(F.first("file_size").alias("file_size"))
    older = Window.partitionBy(F.lit(0)).orderBy(F.desc("age")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    newest = Window.partitionBy(F.lit(0))
    bases = files.select(
        "age", F.coalesce(F.sum("file_size").over(older), F.lit(0)).alias("_file"),
        (F.max("age").over(newest) - F.col("age")).cast("long").alias("generation"),
    )
    placed = splits.join(bases, "age").select(
        *split, "generation", (F.col("_split") + F.col("_file")).alias("_base")
    )
    in_file = F.col("_split_pos") + F.col("_base")
    return (
        sized.withColumn("_split_pos", F.coalesce(F.sum("_full").over(inside), F.lit(0)))
        .join(placed, split)
        .filter(drop_bad_lines("line"))
        .select("generation", "age", in_file.alias("pos"), F.col("_full").alias("nbytes"), "line")
    )


def parse_jsonl(lines: DataFrame, json_only: bool = True) -> DataFrame:
    """The 11 record columns of each ``line``, other columns kept.

    Lines that are no JSON object are dropped, or keep null columns with ``json_only=False``.
    Severity and facility take the case in which this package writes them, so that filters compare
    them as they are; ``line`` keeps what was read.
    """
    kept = lines.filter(drop_bad_lines("line", json_only))
    case = {"severity": F.upper, "facility": F.lower}
    return kept.withColumn("_record", F.from_json("line", RECORD)).select(
        *lines.columns,
        *[case.get(f.name, lambda c: c)(F.col(f"_record.{f.name}")).alias(f.name) for f in RECORD.fields],
    )
