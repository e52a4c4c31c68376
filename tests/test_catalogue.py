"""Each query agrees with its SQL, run by another engine over the same files."""

import math
from pathlib import Path

import duckdb
import pytest

from sediment import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents pages clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    got = found.collect()
    if name not in catalogue.ORACLES:
        assert found.columns
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{Path(sf_dir) / t}.parquet')")
    out = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in out.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(got, found.columns) == rows(out.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
