"""Rows delivered twice at one price: queries and their SQL keep the same one."""

from collections import Counter

import duckdb
import pytest

from lakeforge.plans.queries import oracle_sql, queries
from tests.test_plans import plain


@pytest.fixture
def tied(tmp_path):
    """sf0.001 with 200 order lines that were delivered twice at one price, and differ elsewhere."""
    db = duckdb.connect()
    for t in ("customer", "nation", "orders", "part", "region", "supplier", "lineitem"):
        more = " UNION ALL SELECT * REPLACE (CASE l_returnflag WHEN 'R' THEN 'N' ELSE 'R' END AS l_returnflag, l_quantity + 1 AS l_quantity) FROM (SELECT * FROM t ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey LIMIT 200)" if t == "lineitem" else ""
        db.execute(f"CREATE OR REPLACE TABLE t AS FROM '/root/testdata/sf0.001/{t}.parquet'")
        db.execute(f"COPY (SELECT * FROM t{more}) TO '{tmp_path}/{t}.parquet'")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["fact_repair_order_line", "quarantine_lines", "rule_results"])
def test_ties_are_decided_alike_in_sql(spark, tied, name):
    db = duckdb.connect()
    for t in ("customer", "nation", "orders", "part", "region", "supplier", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS FROM '{tied}/{t}.parquet'")
    cur = db.execute(oracle_sql()[name])
    names = [c[0] for c in cur.description]
    rows = lambda found: Counter(tuple(map(plain, r)) for r in found)
    assert rows(queries()[name](spark, tied).select(*names).collect()) == rows(cur.fetchall())
