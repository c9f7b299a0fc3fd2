"""Sessions, and the package's way to the Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package.

    Once per application the package's sources are zipped and added to the job, as
    ``--py-files`` would. Executors fetch the archive from the driver, so it need
    not be installed anywhere.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="basinflow-src-"), "basinflow.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


_WORK_DIRS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables that the driver and every executor see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a session on
    one machine gets a temporary folder; on a cluster it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _WORK_DIRS:
        _WORK_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="basinflow-")
        spark.sparkContext.setCheckpointDir(_WORK_DIRS[app])
    return _WORK_DIRS[app]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or URI exists, in whatever store Spark reaches it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def shared_path(spark: SparkSession, path: str) -> str:
    """The path, if the driver and all executors can share it; on a cluster one that names no store but the local disk is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    if scheme == "file" and "://" not in path and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{path} is a folder of each machine's own; name its store, or file:// if all machines mount it")
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared work folder and read again.

    For small tables that several joins read, and to cut a long lineage: the files
    outlive any executor.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("basinflow")
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
