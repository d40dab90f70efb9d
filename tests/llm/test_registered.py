"""The registered queries: against their SQL on the smallest tables, and on workers that can't import this package."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op6_license_scan", "op9_embedding_pq", "op11_line_dedup", "op12_spelling_variants", "op13_periodic_runs"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from talkloom.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, told = QUERIES[name](spark, SF), c.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(told.columns)
    at = [told.columns.index(x) for x in cols]
    assert sorted(repr([plain(r[x]) for x in cols]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in told.fetchall())


CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", {tmp!r} + "/w").config("spark.checkpoint.dir", {tmp!r} + "/c").getOrCreate()
def there(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("talkloom") is not None] * b.num_rows)], names=["there"])
assert not spark.range(1).mapInArrow(there, "there boolean").first()["there"]
from talkloom.llm.queries import QUERIES
for name, f in QUERIES.items():
    assert f(spark, {sf!r}).count() > 0, name
assert not spark.catalog.listTables()
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, tmp=str(tmp_path), sf=SF)], cwd=tmp_path, env=env, check=True, timeout=600)
