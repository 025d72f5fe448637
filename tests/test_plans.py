"""Every named query against its SQL, on the smallest tables."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from lakeforge.plans.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (float, Decimal)):
        return None if math.isnan(x) else round(float(x), 5)
    return str(x) if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    db = duckdb.connect()
    for p in Path(FOLDER).iterdir():
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries()[name](spark, FOLDER)
    cur = db.execute(oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.select(*names).collect()) == want
    assert want
