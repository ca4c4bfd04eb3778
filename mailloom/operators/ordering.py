"""Row positions and pages over a total order, without a single-task sort."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailloom.session import settled, staged

#: Keys of a page up to this length are sent to all tasks.
BROADCAST_ROWS = 10_000


def _ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows in sorted ranges, with the number of their range (``__part``) and their place in it (``__local``)."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The low 33 bits count the rows of a partition in its order.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.select("*", F.spark_partition_id().alias("__part"), place.alias("__local"))


def _positions(ranged: DataFrame, out: str) -> DataFrame:
    """Positions over all from written ranges: the counts of the ranges before, plus the place.

    The counts are one row per range, which bounds the only single-task step and
    what is broadcast.
    """
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    starts = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    joined = ranged.join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + F.col("__local"))
    return joined.drop("__part", "__local", "__start")


def with_row_index(df: DataFrame, *order: str | Column, out: str = "row_index", unique: bool = False) -> DataFrame:
    """Zero-based position of every row in a total order.

    Rows are range-partitioned and sorted in parallel and written once, so that
    the ranges cannot move between the two reads. There are at least as many
    ranges as the input has partitions. Where ``order`` are column names that
    together are ``unique``, only these are sorted and written, and the rows meet
    their positions in a join on them.
    """
    if not unique:
        return _positions(settled(_ranges(df, *order)), out)
    index = _positions(settled(_ranges(df.select(*order), *order)), out)
    return _joined(df, index, order)


def _joined(df: DataFrame, keyed: DataFrame, order: tuple[str, ...], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``keyed`` beside the order columns, which may hold NULLs."""
    keys = {name: f"__key{k}" for k, name in enumerate(order)}
    renamed = keyed.withColumnsRenamed(keys)
    same = reduce(and_, (df[name].eqNullSafe(renamed[key]) for name, key in keys.items()))
    return df.join(renamed, same, how).drop(*keys.values())


def with_batch_number(df: DataFrame, size: int, *order: str | Column, out: str = "batch", unique: bool = False) -> DataFrame:
    """Number of the fixed-size batch a row falls in; ``unique`` as for ``with_row_index``."""
    index = "__index"
    numbered = with_row_index(df, *order, out=index, unique=unique)
    return numbered.withColumn(out, F.floor(F.col(index) / F.lit(size))).drop(index)


class PositionIndex:
    """The sorted keys of a table in a folder, with the bounds and row count of each range.

    ``order`` are columns that together are unique. A page or a number of pages
    then reads the ranges that overlap it, and of the table the row groups whose
    first key lies within the page's bounds. It is as old as the table was when it
    was built.
    """

    def __init__(self, spark: SparkSession, path: str, order: tuple[str, ...]):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    @classmethod
    def build(cls, df: DataFrame, path: str, *order: str) -> PositionIndex:
        """Sort and write the order columns alone; no other column is read."""
        index = cls(df.sparkSession, path, order)
        _ranges(df.select(*order), *order).write.partitionBy("__part").parquet(f"{index.path}/keys")
        keys = index._keys()
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        first = F.struct(*order)
        zones = keys.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n"), F.min(first).alias("low"), F.max(first).alias("high"))
        # One row per range: the only step that sees them all.
        zones = zones.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        zones.coalesce(1).write.parquet(f"{index.path}/zones")
        return index

    def _keys(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/keys")

    def zones(self) -> DataFrame:
        """Rows ``part, n, low, high, start``, one for each range that holds keys."""
        return self.spark.read.parquet(f"{self.path}/zones")

    def count(self) -> int:
        return self.zones().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def keys_between(self, start: int, end: int, out: str = "row_index") -> DataFrame:
        """The order columns and positions of rows ``start`` to ``end - 1``, from the ranges that overlap them."""
        zones = self.zones().filter((F.col("start") < end) & (F.col("start") + F.col("n") > start))
        starts = {r["part"]: r["start"] for r in zones.select("part", "start").collect()}
        keys = self._keys().filter(F.col("__part").isin(list(starts)))
        place = F.lit(None).cast("long")
        if starts:
            place = F.create_map(*(F.lit(x) for item in starts.items() for x in item))[F.col("__part")] + F.col("__local")
        return keys.withColumn(out, place).filter((F.col(out) >= start) & (F.col(out) < end)).drop("__part", "__local")

    def page(self, df: DataFrame, limit: int, offset: int) -> DataFrame:
        """``limit`` rows of ``df`` from ``offset`` on.

        The keys of the page are written first; their bounds go to the scan of
        ``df`` as a filter, and a page of up to ``BROADCAST_ROWS`` rows is sent to
        all tasks.
        """
        picked = settled(self.keys_between(offset, offset + limit).drop("row_index"))
        first = self.order[0]
        low, high, odd = picked.agg(F.min(first), F.max(first), F.max(F.col(first).isNull())).first()
        within = F.lit(False) if low is None else F.col(first).between(F.lit(low), F.lit(high))
        near = df.filter(within | F.col(first).isNull() if odd else within)
        return _joined(near, F.broadcast(picked) if limit <= BROADCAST_ROWS else picked, self.order, "left_semi")

    def number(self, df: DataFrame, out: str = "row_index") -> DataFrame:
        """``df`` with the position of every row that the index knows."""
        zones = F.broadcast(self.zones().select(F.col("part").alias("__part"), "start"))
        keys = self._keys().join(zones, "__part").withColumn(out, F.col("start") + F.col("__local"))
        return _joined(df, keys.drop("__part", "__local", "start"), self.order)


def page(df: DataFrame, limit: int, offset: int, *order: str | Column) -> DataFrame:
    """``limit`` rows from ``offset`` in a total order.

    Suited to pages near the start: every task keeps ``offset + limit`` rows.
    ``deep_page`` has no such cost.
    """
    return df.orderBy(*order).offset(offset).limit(limit)


def deep_page(df: DataFrame, limit: int, offset: int, *order: str) -> DataFrame:
    """As ``page`` for any offset and length, by row position.

    ``order`` are columns that together are unique. Only they are sorted and
    written; the positions pick the keys of the page, and these pick the rows.
    """
    with staged(_ranges(df.select(*order), *order), "page-index") as ranged:
        index = _positions(ranged, "__index")
        wanted = (F.col("__index") >= offset) & (F.col("__index") < offset + limit)
        picked = settled(index.filter(wanted).select(*order))
    return _joined(df, F.broadcast(picked) if limit <= BROADCAST_ROWS else picked, order, "left_semi")


def bounded_scan(df: DataFrame, total: int, batch_size: int, start_batch: int, *order: str) -> DataFrame:
    """The rest of the first ``total`` rows from a resume batch on; ``order`` as for ``deep_page``."""
    if batch_size <= 0 or total <= 0 or start_batch < 0:
        raise ValueError("total and batch_size must be above 0, start_batch not below 0")
    offset = start_batch * batch_size
    return deep_page(df, max(total - offset, 0), offset, *order).orderBy(*order)
