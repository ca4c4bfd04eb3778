"""A corpus made ready for training: five operators, each over all that the one before kept.

``STAGES`` lists the stages in order. Each takes the session, the documents so far
and the folder of the tables, and returns the documents it keeps with their
columns; the last returns one row per packed piece. Between stages the documents
are a Parquet table in the shared folder, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm import decontamination, language, line_dedup, packing, simhash
from mailloom.session import new_work_folder, remove_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; it learns from the labelled ones among them."""
    return language.keep_identified(docs, language.train_model(docs))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds; ``n_chars`` follows the text."""
    kept = line_dedup.drop_shared_lines(docs, counts=False)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return simhash.drop_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in token sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack_sequences),
]

#: The language model and the search for few sequences have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return result
        folder = new_work_folder(spark, name)
        result.write.parquet(folder)
        docs = spark.read.schema(result.schema).parquet(folder)
        if before:
            remove_path(spark, before)
        before = folder
    return docs
