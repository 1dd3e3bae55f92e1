"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again."""

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import classifier, mixing, near, pieces, spans
from logweir.llm.common import kept, table, work_folder
from logweir.llm.queries import tokenizer_file

#: SQL cannot express a trained classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on shingles of five words at 0.8."""
    return near.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier."""
    return spans.rewritten(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is there twice."""
    return mixing.mixed_texts(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, and whether they decode to its text and agree with the model's library."""
    return pieces.round_trip(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixture", mixture),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the tables between them lie in the shared folder."""
    folder = work_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), folder, name)
    return docs
