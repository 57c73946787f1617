"""Each registered query of the engine against its DuckDB statement."""

import math

import duckdb
import pytest

from trendspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found):
    norm = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x
    return sorted((tuple(sorted((k, repr(norm(v))) for k, v in r.items())) for r in found), key=repr)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(columns, r, strict=True)) for r in want.fetchall())
