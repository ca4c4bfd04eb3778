"""Quality of documents by boosted trees over statistics of their whole texts.

Labelled texts become numbers in the tasks that read them; a bounded sample of
these numbers is fitted on the driver. The trees are then flat arrays, which every
task walks for a batch of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.llm import boosted_trees
from mailloom.llm.boosted_trees import FlatTrees
from mailloom.llm.text_statistics import NAMES, statistics

#: Least score of a text that counts as good.
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from; false for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def usable_labels(labels: DataFrame, rows: int, id_column: str = "doc_id", label_column: str = "quality") -> DataFrame:
    """(id, label) of at most ``rows`` labelled ids, those with the least hashes.

    Labels other than 0 and 1, NULL ids, held-out ids and ids that have both
    labels are left out.
    """
    named = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    named = named.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    agreed = named.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    return agreed.filter("label = other").select("id", "label").orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(rows)


def _with_numbers(rows: DataFrame, text_column: str) -> DataFrame:
    """``numbers`` in place of the text."""
    kept = [c for c in rows.columns if c != text_column]
    source = rows.select(*kept, F.col(text_column).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [statistics(t.as_py()) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(numbers, pa.list_(pa.float64()))], [*kept, "numbers"])

    return source.mapInArrow(run, source.select(*kept).schema.add("numbers", T.ArrayType(T.DoubleType())))


def train_model(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
) -> FlatTrees:
    """Trees fitted on at most ``sample_rows`` labelled texts.

    At most that many ids are broadcast, and of their texts at most that many,
    picked by a hash of id and numbers, come to the driver as numbers. Documents
    that repeat an id all count. Without labels of both kinds every text has the
    same score.
    """
    picked = usable_labels(labels, sample_rows, id_column, label_column)
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    numbers = _with_numbers(named.join(F.broadcast(picked), "id"), "text")
    sample = numbers.orderBy(F.xxhash64("id", "numbers"), "id").limit(sample_rows).toArrow()
    x = np.array(sample.column("numbers").to_pylist()).reshape(-1, len(NAMES))
    return boosted_trees.fit(x, sample.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: FlatTrees, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from ``threshold`` on).

    Only the text is read, all of it. NULL texts count as empty ones and are
    scored too. Repeated rows give repeated results, an empty table gives none.
    Other columns pass through, but those of the new names are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    source = docs.withColumn("__text", F.col(text_column).cast("string")).select(*kept, "__text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(len(kept))]).reshape(-1, len(NAMES))
            found = shared.value.scores(x)
            new = [pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*kept, "score", "predicted"])

    return source.mapInArrow(run, source.select(*kept).schema.add("score", "double").add("predicted", "integer"))
