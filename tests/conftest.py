import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Apply a Column function to a list of values."""
    from pyspark.sql import functions as F

    def run(fn, items, kind="string"):
        df = spark.createDataFrame(list(enumerate(items)), f"i int, v {kind}")
        rows = df.select("i", fn(F.col("v")).alias("out")).collect()
        return [r["out"] for r in sorted(rows, key=lambda r: r["i"])]

    return run
