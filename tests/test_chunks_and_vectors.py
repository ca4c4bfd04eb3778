"""Chunk windows, ids and vectors."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.functions.ids import point_id, uuid5_url
from mailloom.operators import chunking, embedding


def chunks_of(spark, body, **options):
    df = spark.createDataFrame([("m", "s", "x", body)], "external_message_id string, sender string, subject string, body_cleaned string")
    return [r["chunk_text"] for r in chunking.chunk_emails(df, **options).orderBy("chunk_index").collect()]


def body_of(n):
    return " ".join(f"w{i}" for i in range(n))


def sizes(texts):
    return [len(t.split()) for t in texts]


@pytest.mark.parametrize(
    ("n", "expected"),
    [(1, [1]), (119, [119]), (120, [120, 30]), (239, [120, 120]), (240, [120, 120, 30]), (360, [120, 120, 120, 30])],
)
def test_window_sizes(spark, n, expected):
    assert sizes(chunks_of(spark, body_of(n))) == expected


def test_window_positions(spark):
    got = chunks_of(spark, body_of(400))
    assert [t.split()[0] for t in got] == ["w0", "w90", "w210", "w330"]


def test_empty_bodies(spark):
    spelled = " ".join(rules.EMPTY_BODY)
    assert chunks_of(spark, None) == [spelled] == chunks_of(spark, "")
    assert chunks_of(spark, "  ") == [""]
    assert chunks_of(spark, None, spell_empty=False) == [rules.EMPTY_BODY]
    assert chunks_of(spark, "a b c\n\td") == ["a b c d"]


@pytest.mark.parametrize("n", [1, 30, 31, 120, 121, 210, 211, 239, 240, 330, 1000])
def test_modes_that_cover_all_words(spark, n):
    every = set(body_of(n).split())
    for mode in (chunking.COVER_TAIL, chunking.SLIDING):
        assert set(" ".join(chunks_of(spark, body_of(n), mode=mode)).split()) == every
    assert max(sizes(chunks_of(spark, body_of(n), mode=chunking.SLIDING))) <= rules.CHUNK_WORDS


def test_subject_text(values):
    assert values(chunking.subject_text, [None, "", "x"]) == ["None", "Empty subject", "x"]


def test_uuid5_equals_python(values):
    names = [f"m{i}:{i % 7}" for i in range(200)] + ["", "é", "Илья"]
    assert values(uuid5_url, names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_point_id(values):
    got = values(lambda c: point_id(c, F.lit(3)), ["m1"])
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, "m1:3"))]


def test_embedding_runs_in_batches(spark):
    def make():
        return lambda texts: np.array([[len(t), t.count("x")] for t in texts], dtype=np.float32)

    df = spark.createDataFrame(
        [("m1", "s", "a", 0, "xx"), ("m2", "s", "a", 0, "")],
        "external_message_id string, sender string, subject string, chunk_index int, chunk_text string",
    )
    rows = embedding.embed(chunking.with_point_id(df), make, batch_size=1).collect()
    seen = {r["external_message_id"]: r["vector"] for r in rows}
    want = "Sender: s; Subject: a; Text: xx"
    assert seen == {"m1": [float(len(want)), 3.0], "m2": [float(len(want) - 2), 1.0]}


def test_vector_checks(spark):
    rows = [("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", None), ("e", [1.0, None])]
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    fit, rejected = embedding.split_by_dim(df, dim=2)
    assert {r["id"] for r in fit.collect()} == {"a", "b"}
    assert {r["id"] for r in rejected.collect()} == {"c", "d", "e"}
    got = {r["id"]: r for r in fit.select("id", embedding.norm(F.col("vector")).alias("n"), embedding.unit(F.col("vector")).alias("u"),
                                          embedding.cosine(F.col("vector"), F.col("vector")).alias("cos")).collect()}
    assert got["a"]["n"] == 5.0 and got["a"]["u"] == [0.6, 0.8] and abs(got["a"]["cos"] - 1) < 1e-12
    assert got["b"]["u"] == [0.0, 0.0] and got["b"]["cos"] is None


def test_matrices_become_lists_whole():
    """The rows of an encoder's matrix share one buffer; a matrix that does not fit its texts is an error."""
    import numpy as np

    from mailloom.operators import embedding

    texts = np.array(["a", "b", "c"], dtype=object)
    got = embedding._vectors(lambda t: np.arange(12).reshape(len(t), 4), texts)
    assert got.to_pylist() == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]] and len(got.flatten()) == 12
    with pytest.raises(ValueError, match="3 texts"):
        embedding._vectors(lambda t: np.zeros((2, 4)), texts)
