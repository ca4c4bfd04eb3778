"""Registered queries over tables that are folders of several files."""

import pytest

from checks.compare import TABLES, difference, duck_tables
from checks.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("folders")
    for name in TABLES:
        if name in ("documents", "events"):
            spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(3).write.parquet(f"{out}/{name}.parquet")
        else:
            (out / f"{name}.parquet").symlink_to(f"{SF_DIR}/{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["c19_stream_counters", "r2_vectorize_stream", "r3_classify_stream", "r4_resume_stream"])
def test_streams_read_folders(spark, folders, name):
    got = QUERIES[name](spark, folders).toPandas()
    assert len(got) and difference(got, duck_tables(SF_DIR).sql(ORACLES[name]).df()) is None


def test_redelivered_messages_stay_in_many_tasks(spark, folders, monkeypatch):
    """Neither delivery goes through one task: it is written in as many files as the messages have tasks."""
    from pyspark.sql import functions as F

    from checks import registry

    seen, run = [], registry.streams.import_stream

    def counted(raw, table, *args, **options):
        query = run(raw, table, *args, **options)
        query.awaitTermination()
        folder = raw._jdf.queryExecution().analyzed().toString().split("FileSource[")[1].split("]")[0]
        seen.append(spark.read.parquet(folder).select(F.input_file_name()).distinct().count())
        return query

    monkeypatch.setattr(registry.streams, "import_stream", counted)
    got = QUERIES["r1_redelivered"](spark, folders).toPandas()
    assert difference(got, duck_tables(SF_DIR).sql(ORACLES["r1_redelivered"]).df()) is None
    tasks = registry.fixtures.raw_messages(spark, folders).rdd.getNumPartitions()
    assert seen == [tasks, 2 * tasks] and tasks > 1
