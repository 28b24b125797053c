import os

import duckdb
import pandas as pd
import pytest

from corpuslens.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    cell = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = found.select(*columns).collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    got = con.execute(ORACLE_SQL[name])
    frame = pd.DataFrame(got.fetchall(), columns=[d[0] for d in got.description], dtype=object)
    assert sorted(frame.columns) == columns
    assert plain(rows) == plain(frame[columns].itertuples(index=False))
