"""Every registered telemetry query against its SQL on the small tables."""

import duckdb
import pytest

from quillon.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(found):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.select(*names).collect()) == rows(rel.fetchall())


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_formatted_equals_oracle_at_ties(spark, tmp_path):
    """Sizes and messages on halves, negative, null and very large prices, as the SQL has them."""
    prices = [k * 3000 for k in range(1, 200)] + [k * 256 for k in range(-9, 200)] + [None, -0.5, -7, 0, 0.5] + [3**k / 7 for k in range(30)]
    spark.createDataFrame([(3 * i + r, None if p is None else float(p)) for i, p in enumerate(prices) for r in range(3)], "o_orderkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    rel = c.execute(SQL["s_fmt"])
    names = [d[0] for d in rel.description]
    assert rows(QUERIES["s_fmt"](spark, str(tmp_path)).select(*names).collect()) == rows(rel.fetchall())
