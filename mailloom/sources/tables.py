"""Parquet tables of emails and vector points.

``emails`` is laid out in buckets by the first hex digits of the row id, which
is a hash of the external id: even in size, known from a key alone, and the
unit of rewriting. ``points`` is a Spark table in buckets by id, and an upsert is
one join with it, written anew.

Rows that a table does not take are not lost: they go to a folder beside it,
with the reason.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.functions.ids import bucket
from mailloom.operators import embedding, importing, upsert
from mailloom.schemas import EMAILS, POINTS
from mailloom.session import (
    observed,
    path_exists,
    read_text,
    remove_path,
    staged,
    staged_until_done,
    write_text,
)


class _Folder:
    """A table's folder, a small file with its fixed settings, and the rejected rows beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _settled(self, name: str, given, default):
        """The stored value of a setting; a different one given is an error. Stores a first value."""
        file = f"{self.path}/_settings.json"
        stored = json.loads(read_text(self.spark, file) or "{}")
        if name in stored:
            if given is not None and given != stored[name]:
                raise ValueError(f"{self.path} was written with {name}={stored[name]}, not {given}")
            return stored[name]
        value = default if given is None else given
        if value is not None:
            self._store(name, value)
        return value

    def _store(self, name: str, value) -> None:
        file = f"{self.path}/_settings.json"
        stored = json.loads(read_text(self.spark, file) or "{}")
        write_text(self.spark, file, json.dumps({**stored, name: value}))

    @property
    def rejected_path(self) -> str:
        return f"{self.path}_rejected"

    def reject(self, rows: DataFrame, run: str | None = None) -> None:
        """Keep rows that the table does not take; nothing is written for none.

        Rows of a ``run`` that is repeated take the place of those it left before.
        """
        if not rows.isEmpty():
            folder = f"{self.rejected_path}/run={run or uuid.uuid4().hex}"
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)

    def rejected(self) -> DataFrame | None:
        """All rejected rows so far, None if there never were any."""
        if not path_exists(self.spark, self.rejected_path):
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(self.rejected_path).drop("run")


class EmailTable(_Folder):
    """The emails table at a path, in 16 to the power of ``digits`` buckets.

    Two digits suit up to some hundred gigabytes, three some hundred terabytes.
    The number is stored with the table.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int | None = None):
        super().__init__(spark, path)
        self.digits = self._settled("digits", digits, 2)

    def _bucket(self) -> Column:
        return bucket(F.col("id"), self.digits)

    def read(self) -> DataFrame:
        """All rows with the ``bucket`` column; empty before the first write."""
        schema = T.StructType(EMAILS.fields + [T.StructField("bucket", T.StringType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows = rows.select(*EMAILS.names).withColumn("bucket", self._bucket())
        # Rebalancing gives each bucket few, evenly sized files at any volume.
        # Sorted keys and their filters let a look-up skip row groups.
        writer = (
            rows.hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", "external_message_id")
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .option("parquet.bloom.filter.enabled#external_message_id", "true")
        )
        # Texts hardly repeat: a dictionary of them would be given up after its first page.
        for name in ("body_text", "body_html", "body_cleaned"):
            writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
        writer.partitionBy("bucket").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        self._write(rows, "append")

    def _buckets_of(self, rows: DataFrame) -> list[str]:
        """Buckets that rows with ids fall in; as many as there are buckets at most."""
        return [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect() if r[0] is not None]

    def insert_if_absent(self, rows: DataFrame, order: str = "created_at") -> int:
        """Append rows with a new external id; returns how many there were.

        Of rows that share an external id the first by ``order`` counts, of equal
        ones the least by content; rows without one are all new. Only the buckets that the rows fall in are read
        for keys. The ids already held are staged first: few in the usual
        incremental run, so they are broadcast and the new rows are not moved for
        the check. Safe to repeat: what a broken attempt has written is found and
        skipped.
        """
        seen = Observation("inserted")
        here = self.read().filter(F.col("bucket").isin(self._buckets_of(rows)))
        with (
            staged(importing.existing_ids(here, rows), "existing-ids") as held,
            staged(importing.repeated_keys(rows, order), "repeated-keys") as repeated,
        ):
            new = rows.join(held, "external_message_id", "left_anti")
            once = new.join(repeated, "external_message_id", "left_anti")
            first = importing.keep_first(new.join(repeated, "external_message_id", "left_semi"), order)
            self.append(once.unionByName(first).observe(seen, F.count("*").alias("n")))
        return observed(seen, "n")["n"]

    def _replace(self, touched: list[str], change) -> None:
        """Apply ``change`` to the rows of some buckets and replace those buckets."""
        if not touched:
            return
        with staged_until_done(change(self.read().filter(F.col("bucket").isin(touched))), "rewrite") as changed:
            left = {r[0] for r in changed.select("bucket").distinct().collect()}
            self._write(changed, "overwrite")
            for emptied in set(touched) - left:
                remove_path(self.spark, f"{self.path}/bucket={emptied}")

    def update_bodies(self, updates: DataFrame, order: str | None = None) -> None:
        """Replace bodies by id; see ``upsert.one_update_per_id`` for repeated ids.

        Whether ids repeat is told from the ids alone, together with the buckets;
        bodies are compared only if some do.
        """
        counted = updates.groupBy("id").agg(F.count("*").alias("n")).groupBy(self._bucket().alias("b")).agg(F.max("n"))
        most = dict(counted.collect())  # a row per bucket, and one of updates without an id
        differ = max(most.values(), default=1) == 1
        touched = [b for b in most if b is not None]
        self._replace(touched, lambda rows: upsert.update_bodies(rows, updates, order, ids_differ=differ))

    def delete(self, ids: DataFrame) -> None:
        self._replace(self._buckets_of(ids), lambda rows: upsert.delete_ids(rows, ids))

    def compact(self, max_files: int = 8) -> list[str]:
        """Rewrite the buckets that hold more than ``max_files`` files; returns them."""
        files = self.read().select("bucket", F.input_file_name().alias("file")).distinct()
        many = [r["bucket"] for r in files.groupBy("bucket").count().filter(F.col("count") > max_files).collect()]
        self._replace(many, lambda rows: rows)
        return many


class PointTable(_Folder):
    """The vector points at a path, as a Spark table in buckets by id; ``dim`` is the size that vectors must have, if any.

    Joins by id with the table, reading or upserting, do not move its rows. An
    upsert writes the whole table anew beside the old one and then points to it, so
    it holds entirely or not at all; one that brings more at once costs no more.
    Buckets of about a gigabyte suit; their number is stored with the table.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None, buckets: int | None = None):
        super().__init__(spark, path)
        self.dim = self._settled("dim", dim, None)
        self.buckets = self._settled("buckets", buckets, 16)

    def _name(self, folder: str) -> str:
        return f"points_{folder}"

    def read(self, spark: SparkSession | None = None) -> DataFrame:
        """All points; empty before the first write. A micro-batch reads in its own session."""
        spark = spark or self.spark
        folder = self._settled("rows", None, None)
        if folder is None:
            return spark.createDataFrame([], POINTS)
        name = self._name(folder)
        if not spark.catalog.tableExists(name):
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in POINTS.fields)
            place = f"{self.path}/{folder}".replace("'", "\\'")
            spark.sql(
                f"create table {name} ({fields}) using parquet clustered by (id) sorted by (id) into {self.buckets} buckets location '{place}'"
            )
        return spark.table(name)

    def _write(self, points: DataFrame) -> None:
        """Put ``points`` in place of all rows."""
        old, new = self._settled("rows", None, None), uuid.uuid4().hex
        writer = points.select(*POINTS.names).write.format("parquet").bucketBy(self.buckets, "id").sortBy("id")
        writer.option("path", f"{self.path}/{new}").saveAsTable(self._name(new))
        self._store("rows", new)
        if old is not None:
            self.spark.sql(f"drop table if exists {self._name(old)}")
            remove_path(self.spark, f"{self.path}/{old}")

    def upsert(self, points: DataFrame, *, order: str | None = None, replace_emails: bool = False) -> int:
        """Write points over those with the same id; returns how many were written.

        Of points that share an id in the batch the last by ``order`` counts.
        Vectors of another size than ``dim`` are rejected. With
        ``replace_emails`` the old points of the batch's emails go in the same
        write, so a shorter email leaves no stale tail. Safe to repeat.
        """
        seen = Observation("upserted")
        with staged(points, "points") as batch:
            good = batch
            if self.dim is not None:
                good, bad = embedding.split_by_dim(batch, dim=self.dim)
                self.reject(bad.withColumn("reason", F.lit(f"vector size is not {self.dim}")))
            new = upsert.one_point_per_id(good, order).select(*POINTS.names).observe(seen, F.count("*").alias("n"))
            if self._settled("rows", None, None) is None:
                self._write(new.repartition(self.buckets, "id"))
            else:
                self._write(upsert.merge_points(self.read(new.sparkSession), new, replace_emails=replace_emails))
        return observed(seen, "n")["n"]
