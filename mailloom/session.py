"""Session defaults and the few places that need a shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Messages can be tens of megabytes each, so Arrow batches are bounded by
    # bytes first and by rows second.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    # Checkpointed frames that are out of use leave no files behind.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "mailloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package defaults; cluster settings win where given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a fresh temporary
    folder; a cluster without it is an error, because executors could not
    reach a machine-local path.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="mailloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_work_folder(spark: SparkSession, label: str) -> str:
    """A folder name under the shared root that no other run uses."""
    return f"{shared_root(spark)}/mailloom-{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def remove_path(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of the shared store, None if it is not there."""
    if not path_exists(spark, path):
        return None
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def _write_once(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    folder = new_work_folder(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, for results that must not be computed twice.

    The files survive the loss of executors; Spark's cleaner removes them once
    the frame is out of use, where the cluster asks for it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


@contextmanager
def staged_until_done(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """As ``staged``, but if the block fails the table is kept and the error names it.

    For blocks that replace what they have read: the written table may then be
    the only full copy.
    """
    table, folder = _write_once(df, label)
    try:
        yield table
    except Exception as error:
        raise RuntimeError(f"a full copy of the rows is kept in {folder}") from error
    remove_path(df.sparkSession, folder)


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """Write ``df`` once to the shared folder and read it back, within a block.

    Used where an expensive or order-sensitive result is read more than once,
    and where a join should know the true size of a side: Spark broadcasts the
    table read back only if its files are below the broadcast threshold. The
    written table survives the loss of executors and goes at the end of the block.
    """
    table, folder = _write_once(df, label)
    try:
        yield table
    finally:
        remove_path(df.sparkSession, folder)


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the scan gives fewer splits than task slots.

    A table of many files already has enough splits and passes unchanged; a
    single small file would otherwise run the whole job on one core.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots)


def observed(observation: Observation, *names: str) -> dict[str, int]:
    """Counts of a finished write.

    Where the rows turn out to be none while running, Spark cuts the plan and
    the observation holds no row; the counts are zero then.
    """
    try:
        return {name: observation.get[name] for name in names}
    except Py4JJavaError as error:
        if "toPyRow" not in str(error):
            raise
        return dict.fromkeys(names, 0)
