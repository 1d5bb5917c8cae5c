import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from vigilake.plans import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) or hasattr(value, "as_tuple"):
        return "nan" if math.isnan(value) else float(f"{float(value):.9g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, DATA)
    found = tables.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_tiles_change_nothing(spark):
    whole, cut = (registry.QUERIES[n](spark, DATA) for n in ("background_activity", "tiled_background_activity"))
    assert whole.exceptAll(cut).count() == 0 == cut.exceptAll(whole).count()
