import os

import duckdb
import pytest

from ledgerlark.llm import registry, twins

SF = "/root/testdata/sf0.001"


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(twins.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    found = con.execute(twins.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in found.fetchall())
