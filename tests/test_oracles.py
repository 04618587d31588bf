import os

import duckdb
import pytest

from sonolex import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("part", "benchmark"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(map(str, r))
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=key)
    assert a == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)


def test_entry_without_the_corpus_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(SF)
