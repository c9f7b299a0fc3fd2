"""Incremental caches on any store that Spark writes to: parts in committed versions, and a manifest table.

A build writes the rows of its parts below ``rows/version=V/part=P``, then appends to
``manifest`` a row for each part: what it was made from, how many rows it has, their
columns, and V.
Rows count only through the manifest's latest row of a part, so a build that is broken
off leaves nothing that is read, and parts are never replaced while they may be read.
Which parts are stale is a join in Spark; part names and fingerprints aren't held by the
driver.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists, shared_path, written

SCHEMA = "part string, digest string, frames long, version string, fields string, number long"


def part_name(key: str) -> str:
    """Folder name of a key: readable, and unique by a short hash."""
    return f"{re.sub('[^A-Za-z0-9._-]', '_', key)[:60]}-{hashlib.sha1(key.encode()).hexdigest()[:8]}"


def part_names(key: Column) -> Column:
    """Folder names of a column of keys."""
    return F.concat(F.substring(F.regexp_replace(key, "[^A-Za-z0-9._-]", "_"), 1, 60), F.lit("-"), F.substring(F.sha1(key), 1, 8))


def digest(value: Any) -> str:
    """Digest of a JSON value."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


class Store:
    """A cache below a path or URI."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, shared_path(spark, root).rstrip("/")

    def committed(self) -> DataFrame:
        """(part, digest, frames, version, fields): the latest commit of each part."""
        path = f"{self.root}/manifest"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], SCHEMA).drop("number")
        rows = self.spark.read.schema(SCHEMA).parquet(path)
        last = rows.groupBy("part").agg(F.max(F.struct("number", "digest", "frames", "version", "fields")).alias("m"))
        return last.select("part", "m.digest", "m.frames", "m.version", "m.fields")

    def _counts(self, versions: Sequence[str]) -> DataFrame:
        """(part, version, found): rows that the versions have; counting reads no column."""
        paths = [p for v in versions if path_exists(self.spark, p := f"{self.root}/rows/version={v}")]
        if not paths:
            return self.spark.createDataFrame([], "part string, version string, found long")
        rows = self.spark.read.schema("version string, part string").option("basePath", f"{self.root}/rows").parquet(*paths)
        return rows.groupBy("part", "version").agg(F.count(F.lit(1)).alias("found"))

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of wanted (part, digest, ...) whose part isn't committed with that digest, or lacks rows of its commit."""
        current = wanted.select("part", "digest").join(self.committed(), ["part", "digest"])
        versions = [r[0] for r in current.select("version").distinct().collect()]
        whole = current.join(self._counts(versions), ["part", "version"], "left").where(F.coalesce("found", F.lit(0)) == F.col("frames"))
        return wanted.join(whole.select("part"), "part", "left_anti")

    def write(self, rows: DataFrame, parts: DataFrame) -> None:
        """Writes rows (with a column ``part``) and commits parts (part, digest), also those without a row."""
        version = uuid.uuid4().hex
        folder = f"{self.root}/rows/version={version}"
        fields = T.StructType([f for f in rows.schema if f.name != "part"]).json()
        rows.write.partitionBy("part").parquet(folder)
        number = self.spark.range(1).select(F.lit(0).alias("number"))
        if path_exists(self.spark, f"{self.root}/manifest"):
            number = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/manifest").agg((F.coalesce(F.max("number"), F.lit(-1)) + 1).alias("number"))
        made = parts.select("part", "digest").join(self._counts([version]).drop("version"), "part", "left")
        done = made.select("part", "digest", F.coalesce("found", F.lit(0)).alias("frames"), F.lit(version).alias("version"), F.lit(fields).alias("fields"), F.lit(number.first()[0]).cast("long").alias("number"))
        # written apart first: a failure in the counting leaves the manifest as it is
        written(done, "commit").coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def read(self, wanted: DataFrame) -> DataFrame:
        """Rows of committed parts (part, digest, ...) with wanted's other columns; an error if one isn't committed, or lacks rows.

        Only folders of versions that the wanted parts have are listed.
        """
        parts = written(wanted.join(self.committed(), ["part", "digest"], "left"), "parts")
        versions = [r[0] for r in parts.where("frames > 0").select("version").distinct().collect()]
        lacking = parts.join(self._counts(versions), ["part", "version"], "left").where(F.col("frames").isNull() | (F.coalesce("found", F.lit(0)) != F.col("frames"))).select("part").limit(1).collect()
        if lacking:
            raise FileNotFoundError(f"the cache {self.root} lacks rows of part {lacking[0][0]!r} that its manifest has")
        fields = parts.select("fields").first()
        if fields is None:
            raise ValueError("no part is wanted of the cache")
        schema = T.StructType.fromJson(json.loads(fields[0]))
        more = [c for c in wanted.columns if c not in ("part", "digest")]
        if not versions:
            return self.spark.createDataFrame([], T.StructType([*schema, *(wanted.schema[c] for c in more)]))
        typed = T.StructType([*schema, T.StructField("version", T.StringType()), T.StructField("part", T.StringType())])
        rows = self.spark.read.schema(typed).option("basePath", f"{self.root}/rows").parquet(*[f"{self.root}/rows/version={v}" for v in versions])
        return rows.join(parts.select("part", "version", *more), ["part", "version"]).drop("part", "version")


def kept(store: Store, name: str, wanted: Mapping[str, Any], make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """A named table made for a fingerprint, from the store or, by ``make()``, anew; and whether it was kept."""
    spark = store.spark
    part = spark.createDataFrame([(part_name(name), digest(wanted))], "part string, digest string")
    old = store.missing(part).isEmpty()
    if not old:
        store.write(make().withColumn("part", F.lit(part_name(name))), part)
    return store.read(part), old
