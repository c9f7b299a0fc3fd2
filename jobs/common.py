"""What both jobs share: their config, their log and their command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

LOG = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str) -> dict[str, Any]:
    """The JSON config file at a path that Spark reads, local or remote."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def main(run: Callable[..., dict[str, int]], text: str, argv: list[str] | None = None) -> None:
    """Runs a job from the command line, with a session of its own."""
    parser = argparse.ArgumentParser(description=text)
    for name, what in (("source", "folder or files to read"), ("target", "folder to write"), ("checkpoint", "folder for the job's marks and work tables, kept between runs"), ("config", "JSON config file")):
        parser.add_argument(f"--{name}", required=True, help=what)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, args.source, args.target, args.checkpoint, read_config(spark, args.config))
    finally:
        spark.stop()
