"""Run queries against their SQL: python tests/check.py DIR [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

import __spark_entry__ as e
from compare import compare, connect


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = e.queries(), e.oracle_sql()
    con = connect(sf_dir)
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracle:
                problem = compare(queries[name](spark, sf_dir), con, oracle[name])
                word = "same" if problem is None else "DIFF"
            else:
                n = queries[name](spark, sf_dir).count()
                problem, word = (None, f"rows {n}") if n else ("no rows", "DIFF")
        except Exception as error:
            problem, word = f"{type(error).__name__}: {str(error)[:900]}", "FAIL"
        bad += problem is not None
        print(f"{word:10} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("problems:", bad)


main()
