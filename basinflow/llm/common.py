"""Session plumbing shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from basinflow.session import ship_package, work_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Written tables of one operator call, in the shared folder.

    ``keep`` writes a DataFrame as Parquet and rereads it, which cuts its lineage
    with files that outlive any executor. ``drop`` removes a table that nothing
    reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        # the tables themselves are held, so that no other object can take their id
        self._kept: dict[int, tuple[DataFrame, str]] = {}
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        # the schema is known: no job to infer it, and an empty table stays readable
        out = self.spark.read.schema(df.schema).parquet(path)
        self._kept[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            _, path = self._kept.pop(id(t), (None, None))
            if path:
                hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
                fs.delete(hadoop, True)
