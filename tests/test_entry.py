import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SMALL = Path("/root/testdata/sf0.001")

CODE = """
import os, sys
os.chdir("/")
os.environ.pop("PYTHONPATH", None)
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", e.queries()["p6_found"](spark, {data!r}).count())
"""


@pytest.mark.skipif(not SMALL.exists(), reason="no test data")
def test_workers_find_the_package_from_anywhere():
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), data=str(SMALL))], capture_output=True, text=True, timeout=120, cwd="/")
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def test_contract():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and all(callable(f) for f in q.values())
    assert {"p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found"} <= set(q)


@pytest.mark.skipif(not SMALL.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["trace_list", "service_edges", "span_tree", "metric_points", "nearest_point", "p2_found", "p3_found", "p4_found", "p7_found"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("spans", "logs", "metric_points"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = e.queries()[name](spark, str(SMALL))
    cur = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*[got[c] for c in names]).collect()))) == sorted(map(repr, cur.fetchall()))
