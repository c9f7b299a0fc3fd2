"""Queries in a process of their own, whose workers don't find the package by themselves."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from basinflow.llm import catalog
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", catalog.queries()[sys.argv[2]](spark, sys.argv[3]).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op3_private_data", "op8_toxicity", "op11_whitening", "op12_run_length_repeats"])
def test_first_query_of_a_session(name, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, ROOT, name, SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0 and "ROWS" in done.stdout, done.stderr[-1500:]
