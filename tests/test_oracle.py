"""Every query of the reference's own operators against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from sightline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v is pd.NA or v != v else f"{v:.4f}" if isinstance(v, float) else str(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def same(spark, name, sf):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # whole numbers stay whole where a null makes pandas read them as floating
        if got[c].dtype.kind in "if" and want[c].dtype.kind in "if":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)
    return len(got)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, name, SF)
