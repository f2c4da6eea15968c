"""The package from another working directory, as a driver or cluster starts it."""

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
print("rows", contract.queries()["stream_nudge_trigger"](spark, "{SMALL}").count())
spark.stop()
"""


def test_python_state_runs_without_the_package_on_the_workers_path():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd="/tmp", env=env, capture_output=True, text=True, timeout=300)
    assert "rows 4" in done.stdout, done.stderr[-2000:]
