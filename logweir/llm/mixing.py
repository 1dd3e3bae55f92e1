"""Mixing sources to target weights: random keys, distributed prefix sums, exact budgets, repeated epochs."""

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import WORD, arrow_map, kept, prefix_sums, words, work_folder
from logweir.operators.joins import is_small

#: Weights dealt to the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words, and no source more than this many times its own.
SHARE, EPOCHS = 1.5, 2
SEED = "mix-1"
#: Texts that a task holds while it counts or cuts them.
TEXTS = 256


def with_size(docs: DataFrame, name: str = "size", keep: bool = False) -> DataFrame:
    """doc_id and source, or with ``keep`` whole rows in a column ``mix_row``, and the number of words of the text.

    Words are counted where the text is read, a few texts at a time, and only numbers go on."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row")] if keep else []
    own = docs.select(*row, "doc_id", "source", *([] if keep else ["text"]))
    shape = T.StructType([f for f in own.schema if f.name != "text"] + [T.StructField(name, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                texts = pc.struct_field(batch.column(0), "text") if keep else batch.column(2)
                sizes = pa.array([len(words(t)) for t in texts.to_pylist()], pa.int64())
                kept_columns = batch.columns if keep else batch.columns[:2]
                yield pa.RecordBatch.from_arrays([*kept_columns, sizes], names=[f.name for f in shape])

    return arrow_map(own, count, shape)


def _ranked(sources: DataFrame, folder: str) -> DataFrame:
    """Sources with their place in code-point order, null last."""
    counted = sources.withColumn("one", F.lit(1).cast("long"))
    order = [F.col("source").isNull(), F.col("source")]
    return prefix_sums(counted, order, "one", f"{folder}/sources").withColumnRenamed("before", "place").drop("one")


def targets(sources: DataFrame, folder: str, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with ``target``: the mix dealt by weight, each source held at ``epochs`` sizes.

    What a full source cannot take is dealt again by weight. Each pass fixes every source that the present
    level fills; there are at most as many passes as sources, and a handful in practice. A pass moves two
    numbers to the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    level = _ranked(sources, folder).withColumn("weight", weight.cast("long"))
    part = Fraction(share).limit_denominator(1000)
    whole = level.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size").cast("double") * F.lit(float(epochs))
    rest, weighed, target = part.numerator * whole, None, F.lit(0.0)
    while True:
        free = level if weighed is None else level.where(target <= most)
        row = free.agg(F.sum("weight"), F.sum("source_size")).first()
        if row[0] is None or row[0] == weighed:
            break
        weighed = row[0]
        rest = part.numerator * whole - part.denominator * epochs * (whole - row[1])
        target = F.lit(rest) * F.col("weight") / F.lit(float(part.denominator * weighed))
    return level.select("source", "source_size", F.least(target, most).alias("target"))


def mix_words(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """How many words of every document the mix takes: (doc_id, size, source_size, target, taken).

    Documents of a source stand in the order of a hash of their id; sums over that order place each of them,
    and the source's budget, the whole words of its target, is cut exactly: whole epochs first, then the
    documents before the cut, and of the document at the cut its first words. A hot source is spread over
    many ranges by its keys. Rows with one doc_id are separate documents; a null text has no words; a null
    source is a source; rows without words take nothing; no rows give no rows.
    """
    folder = work_folder(docs.sparkSession, "mix")
    return mix_sizes(kept(with_size(docs), folder, "sizes"), folder, weights, share, epochs, seed)


def mix_sizes(narrow: DataFrame, folder: str, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """:func:`mix_words` of stored (doc_id, source, size) rows; ranges are drawn from numbers, no text is read again."""
    keyed = narrow.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    order = [F.col("source").isNull(), F.col("source"), F.col("key"), F.col("doc_id"), F.col("size")]
    placed = prefix_sums(keyed, order, "size", folder)
    firsts = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("first"))
    goals = targets(firsts.select("source", "source_size"), folder, weights, share, epochs)
    known = goals.withColumnRenamed("source", "s").join(
        firsts.select(F.col("source").alias("f"), "first"), F.col("s").eqNullSafe(F.col("f"))).drop("f")
    # One row a source: a hot source is not gathered in one task.
    rows = placed.join(F.broadcast(known) if is_small(known) else known, F.col("source").eqNullSafe(F.col("s")))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("before") - F.col("first"))))
    taken = whole * F.col("size") + part
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every epoch of a document, and for the document
    at the cut the words up to it. ``n_chars``, where there is such a column, follows the text. Rows alike
    in id, source and number of words are taken equally often."""
    folder = work_folder(docs.sparkSession, "mix")
    own = kept(with_size(docs, "mix_words", keep=True), folder, "rows")
    narrow = own.select("doc_id", "source", F.col("mix_words").alias("size"))
    taken = mix_sizes(narrow, folder, **settings).groupBy(
        F.col("doc_id").alias("mix_doc"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"),
    ).agg(F.max("taken").alias("mix_taken")).where("mix_taken > 0")
    same = (F.col("doc_id").eqNullSafe(F.col("mix_doc")) & F.col("source").eqNullSafe(F.col("mix_source"))
            & (F.col("mix_words") == F.col("mix_size")))
    copies = own.join(taken, same).withColumn("mix_copy", F.explode(F.expr("sequence(0L, (mix_taken - 1) div mix_size)")))
    left = (F.col("mix_taken") - F.col("mix_copy") * F.col("mix_size")).cast("int")
    # At most one document a source is cut; of the others the text goes on as it is.
    pieces = F.regexp_extract_all("mix_row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(left >= F.col("mix_size"), F.col("mix_row.text")).otherwise(
        F.array_join(F.slice(pieces, F.lit(1), left), ""))
    shown = {"text": F.col("mix_text"), "n_chars": F.length("mix_text")}
    return copies.withColumn("mix_text", text).select(*[
        shown.get(f.name, F.col(f"mix_row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema])
