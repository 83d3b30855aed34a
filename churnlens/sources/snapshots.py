"""Versioned snapshots of tables, published by a manifest.

A store is a folder with ``data/`` (one folder per version, written whole and never changed) and
``manifest/`` (one small Parquet file per published version, written last, so that it appears in
one step).  A manifest names the version, where its tables lie and what it was made from: a row
per source file with size and time, or per named batch.  Readers take the newest manifest, so a
refresh that dies leaves the version before it as it was, and readers of that version are not
disturbed by a newer one.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, list_path

_SOURCES = "source string, length long, modified timestamp"
_MANIFEST = f"version long, data string, {_SOURCES}"


class Version(NamedTuple):
    number: int
    data: str


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, length, modified) of every file below ``path``; the files are listed, not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select(F.col("path").alias("source"), "length", F.col("modificationTime").alias("modified")))


def named_sources(spark: SparkSession, *names: str) -> DataFrame:
    """Sources that are named rather than listed, for example the batches of a feed."""
    return spark.createDataFrame([(n, None, None) for n in names], _SOURCES)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that have been published below ``path``; none where nothing has."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def publish(rows: DataFrame, path: str) -> None:
    """Add rows to the log ``path``: one file, which a rename brings into place, so that readers
    see all of them or none."""
    rows.coalesce(1).write.parquet(f"{path}/{uuid.uuid4().hex}")


class SnapshotStore:
    """A store below ``root``, which driver and executors must share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self) -> DataFrame:
        return read_log(self.spark, f"{self.root}/manifest", _MANIFEST)

    def newest(self) -> Version | None:
        """The newest published version; of two writers that took the same number one counts."""
        row = self._manifest().agg(F.max(F.struct("version", "data")).alias("v")).first()
        return Version(*row.v) if row.v else None

    def sources(self) -> DataFrame:
        """What the newest version was made from."""
        newest = self.newest()
        rows = self._manifest().where("source IS NOT NULL")
        return (rows.where(F.col("data") == newest.data) if newest else rows).select("source", "length", "modified")

    def is_made_from(self, sources: DataFrame) -> bool:
        """Whether the newest version was made from just these files, by name, size and time."""
        if self.newest() is None:
            return False
        change = F.when(F.col("here") != F.col("there"), 1)
        sides = [s.select(F.struct("source", "length", "modified").alias("s"), F.lit(a).alias("here"), F.lit(b).alias("there"))
                 for s, a, b in ((sources, 1, 0), (self.sources(), 0, 1))]
        both = sides[0].union(sides[1]).groupBy("s").agg(F.max("here").alias("here"), F.max("there").alias("there"))
        return both.where(change == 1).isEmpty()

    def write(self, tables: dict[str, DataFrame], sources: DataFrame | None = None,
              partition_by: tuple[str, ...] = ()) -> Version:
        """Write ``tables`` as a new version, then publish it."""
        newest = self.newest()
        version = Version(newest.number + 1 if newest else 1, f"{self.root}/data/{uuid.uuid4().hex}")
        for name, df in tables.items():
            df.write.partitionBy(*partition_by).parquet(f"{version.data}/{name}")
        self.publish(version, sources)
        return version

    def publish(self, version: Version, sources: DataFrame | None = None) -> None:
        own = [F.lit(version.number).cast("long").alias("version"), F.lit(version.data).alias("data")]
        rows = self.spark.range(1).selectExpr("CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS length",
                                              "CAST(NULL AS TIMESTAMP) AS modified")
        if sources is not None:
            rows = rows.union(sources.select("source", "length", "modified"))
        publish(rows.select(*own, "source", "length", "modified"), f"{self.root}/manifest")

    def read(self, table: str = "rows", version: Version | None = None) -> DataFrame:
        version = version or self.newest()
        if version is None:
            raise FileNotFoundError(f"{self.root} holds no published version")
        return self.spark.read.parquet(f"{version.data}/{table}")

    def vacuum(self, keep: int = 2) -> int:
        """Delete the data of all but the newest ``keep`` versions, and of writes that were never
        published; how many folders went.  Not while another job refreshes the store."""
        versions = [r.data for r in self._manifest().groupBy("data").agg(F.max("version").alias("v"))
                    .orderBy(F.desc("v"), F.desc("data")).limit(keep).collect()]
        kept = {v.rsplit("/", 1)[-1] for v in versions}
        gone = [p for p in list_path(self.spark, f"{self.root}/data") if p.rsplit("/", 1)[-1] not in kept]
        for path in gone:
            delete_path(self.spark, path)
        return len(gone)
