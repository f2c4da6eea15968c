"""Operators where workers do not have the package on their path."""

import os
import subprocess
import sys

from paths import ROOT, SMALL

SCRIPT = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("contract", "{ROOT}/__spark_entry__.py")
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name, query in contract.queries().items():
    if name.split("_")[0] in ("op2", "op4", "op8", "op10", "op13"):
        print("rows", name, query(spark, "{SMALL}").count())
spark.stop()
"""


def test_operators_run_without_the_package_on_the_workers_path():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd="/tmp", env=env, capture_output=True, text=True, timeout=600)
    rows = [line.split()[1:] for line in done.stdout.splitlines() if line.startswith("rows")]
    assert len(rows) >= 4 and all(n == "200" for _, n in rows), done.stderr[-2000:]
