"""Tables as plain Parquet that Spark writes and reads: versions of rows, and a keyed table made of them.

A version is a folder of rows; it exists once its row stands in the table of commits, which is written last. Writing a
version that exists does nothing, and writing one again that was never committed replaces its folder, so repeated
micro-batches are harmless and half-written versions are never read. Dropping a version overwrites it with nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary import schemas
from tributary.operators import changes

COMMITS = schemas.struct("version bigint, tag string")
STATE = "id string, change_id bigint, op string"
DOCUMENT = "text string, meta string, ts bigint"
BUCKETS = 64


def _read(spark: SparkSession, path: str, schema: T.StructType | None, kind: str = "parquet") -> DataFrame | None:
    """The rows under ``path``; None where nothing has been written."""
    reader = spark.read.format(kind)
    try:
        return (reader.schema(schema) if schema is not None else reader).load(path)
    except AnalysisException as failure:
        if failure.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class Versions:
    """Rows written version by version under ``path``, each version in files by ``bucket`` if ``buckets`` is given."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType | None, buckets: int = 0, kind: str = "parquet",
        rows_per_file: int = 0,
    ):
        self.spark, self.path, self.schema, self.buckets, self.kind = spark, path.rstrip("/"), schema, buckets, kind
        self.rows_per_file = rows_per_file

    @property
    def commit_path(self) -> str:
        return f"{self.path}/commits"

    def commits(self) -> DataFrame:
        found = _read(self.spark, self.commit_path, COMMITS)
        return found if found is not None else self.spark.createDataFrame([], COMMITS)

    def newest(self, upto: int | None = None) -> int:
        """The newest version, of those up to ``upto`` if given; -1 if there is none."""
        found = self.commits() if upto is None else self.commits().where(F.col("version") <= upto)
        return found.agg(F.coalesce(F.max("version"), F.lit(-1)).alias("v")).first()["v"]

    def has(self, version: int) -> bool:
        return not self.commits().where(F.col("version") == version).isEmpty()

    def tagged(self, tag: str) -> int | None:
        """The version that was written with ``tag``."""
        return self.commits().where(F.col("tag") == tag).agg(F.max("version")).first()[0]

    def write(self, rows: DataFrame, version: int, tag: str | None = None) -> bool:
        """Write ``rows`` as ``version``; False if it is there already."""
        if self.has(version):
            return False
        self._overwrite(rows, version)
        marked = self.spark.createDataFrame([(version, tag)], COMMITS)
        marked.coalesce(1).write.mode("append").parquet(self.commit_path)
        return True

    def _overwrite(self, rows: DataFrame, version: int) -> None:
        if self.schema is not None:
            rows = schemas.conform(rows, self.schema)
        if self.buckets:
            rows = rows.withColumn("bucket", bucket_of(F.col("id"), self.buckets)).repartition("bucket")
        writer = rows.write.mode("overwrite").format(self.kind)
        if self.buckets:
            writer = writer.partitionBy("bucket")
        if self.rows_per_file:
            writer = writer.option("maxRecordsPerFile", self.rows_per_file)
        writer.save(f"{self.path}/rows/version={version}")

    def _all(self) -> DataFrame | None:
        more = [T.StructField("version", T.LongType())] + ([T.StructField("bucket", T.IntegerType())] if self.buckets else [])
        schema = T.StructType(self.schema.fields + more) if self.schema is not None else None
        return _read(self.spark, f"{self.path}/rows", schema, self.kind)

    def read(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """The rows of the versions in ``(after, upto]`` with their ``version``; up to the newest by default."""
        rows = self._all()
        if rows is None:
            columns = [*(self.schema.fields if self.schema is not None else []), T.StructField("version", T.LongType())]
            if self.buckets:
                columns.append(T.StructField("bucket", T.IntegerType()))
            return self.spark.createDataFrame([], T.StructType(columns))
        newest = self.newest(upto)
        return rows.where((F.col("version") > after) & (F.col("version") <= newest))

    def read_only(self, versions: list[int]) -> DataFrame:
        """The rows of some versions."""
        return self.read().where(F.col("version").isin(versions))

    def touched(self, after: int, upto: int) -> list[int]:
        """The buckets that versions in ``(after, upto]`` have rows in, from the names of their files."""
        rows = self._all()
        names = rows.inputFiles() if rows is not None else []
        found = (re.search(r"/version=(\d+)/bucket=(\d+)/", name) for name in names)
        return sorted({int(m[2]) for m in found if m and after < int(m[1]) <= upto})

    def drop(self, upto: int) -> int:
        """Leave nothing of versions up to ``upto``; returns how many had rows. They stay committed."""
        if upto < 0:
            return 0
        doomed = [r["version"] for r in self.read(upto=upto).select("version").distinct().collect()]
        for version in doomed:
            self._overwrite(self.spark.createDataFrame([], self.schema), version)
        return len(doomed)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class MergeTable:
    """Rows by key with the change that last set them, in typed columns. Keys are text in column ``id``.

    Applying a batch writes its folded rows only, into files by a hash of the key. A read takes the newest base and
    the deltas since; only buckets that a delta touches are folded, the others are read as they are. ``compact``
    makes a new base. Deleted keys stay as tombstones with the id of their last change, so that a change that
    arrives late and is older than what is stored is ignored.

    ``typed`` turns effects ``(id, change_id, op, image)`` into the table's columns. ``extra`` names further columns
    stored with each row, such as a vector.
    """

    def __init__(
        self, spark: SparkSession, path: str, columns: str = DOCUMENT, extra: str | None = None,
        typed: Callable[[DataFrame], DataFrame] = changes.document_state, buckets: int = BUCKETS,
    ):
        self.spark, self.path, self.typed, self.buckets = spark, path.rstrip("/"), typed, buckets
        self.schema = schemas.struct(", ".join(filter(None, [STATE, columns, extra])))
        self.bases = Versions(spark, f"{self.path}/base", self.schema, buckets)
        self.deltas = Versions(spark, f"{self.path}/delta", self.schema, buckets)

    def version(self) -> int:
        """The newest version; -1 for an empty table."""
        return max(self.bases.newest(), self.deltas.newest())

    def apply(self, rows: DataFrame, version: int) -> bool:
        """Commit ``rows`` (the table's columns, several per key allowed) as ``version``; False if it is there already."""
        if version <= self.bases.newest():
            return False
        return self.deltas.write(changes.fold(rows.select(*self.schema.names)), version)

    def state(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Last change per key as of ``version`` (newest by default), tombstones included; of some buckets, if given."""
        newest = self.version() if version is None else version
        start = self.bases.newest(newest)
        base = self.bases.read_only([start]).drop("version")
        delta = self.deltas.read(start, newest).drop("version")
        touched = self.deltas.touched(start, newest)
        if buckets is not None:
            base, delta = base.where(F.col("bucket").isin(buckets)), delta.where(F.col("bucket").isin(buckets))
            touched = sorted(set(touched) & set(buckets))
        if not touched:
            return base.select(*self.schema.names)
        stirred = F.col("bucket").isin(touched)
        calm = base.where(~stirred).select(*self.schema.names)
        return calm.unionByName(changes.fold(base.where(stirred).unionByName(delta).drop("bucket")).select(*self.schema.names))

    def rows(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Live rows."""
        return changes.live(self.state(version, buckets))

    def touching(self, keys: DataFrame) -> DataFrame:
        """The live rows whose key occurs in ``keys(id)``; only their buckets are read, and of an empty table none are looked for."""
        if self.version() < 0:
            return self.rows(buckets=[])
        asked = keys.select(bucket_of(F.col("id"), self.buckets).alias("b")).distinct().collect()  # at most ``buckets`` rows
        return changes.touching(self.rows(buckets=sorted(r["b"] for r in asked)), keys)

    def compact(self, forget_below: int | None = None) -> int:
        """Write the current state as a new base and return its version.

        Tombstones of changes below ``forget_below`` are left out: pass a change id that no late
        change can undercut any more. Older versions stay until :meth:`expire`.
        """
        version = self.version()
        state = self.state()
        if forget_below is not None:
            state = state.filter((F.col("op") != "delete") | (F.col("change_id") >= forget_below))
        self.bases.write(state, version)
        return version

    def expire(self) -> int:
        """Drop what the newest base replaces; only for versions no reader or replica still needs."""
        base = self.bases.newest()
        return self.bases.drop(base - 1) + self.deltas.drop(base)

    def replace(self, state: DataFrame, version: int) -> bool:
        """Make ``state`` the table as of ``version``; nothing of what was there before stays."""
        return self.bases.write(state, version)


def bootstrap(master: MergeTable, replica: MergeTable) -> int:
    """Copy what the master shows now into an empty replica; returns the copied version."""
    version = master.version()
    if version >= 0 and replica.version() < version:
        replica.replace(master.state(version), version)
    return version


def pull(master: MergeTable, replica: MergeTable) -> bool:
    """Bring ``replica`` up to the master's newest version; whether anything was new.

    Where the master has compacted since, deletions may be forgotten there, so its state replaces the replica's.
    """
    have, newest = replica.version(), master.version()
    if newest <= have:
        return False
    if master.bases.newest() > have:
        return replica.replace(master.state(newest), newest)
    delta = master.deltas.read(have, newest).select(*master.schema.names)
    return replica.apply(delta, newest) and not delta.isEmpty()
