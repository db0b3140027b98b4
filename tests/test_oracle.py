"""Every registered query against its SQL in DuckDB (sf 0.001; tests/oracle.py runs other sizes)."""

import oracle
import pytest

from __spark_entry__ import entry, oracle_sql, queries

PATH = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
SQL = oracle_sql()
# checked by brute force where the optional subpackage is installed
NO_SQL = {n for n in queries() if n == "pipeline" or n.startswith("op")}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(PATH)


@pytest.mark.parametrize("name", sorted(set(queries()) - NO_SQL))
def test_query(spark, con, name):
    err = oracle.compare(spark, con, name, queries()[name], SQL.get(name), PATH)
    if err == "EMPTY on both sides":  # too few rows at this size says nothing
        err = oracle.compare(spark, oracle.connect(LARGER), name, queries()[name], SQL.get(name), LARGER)
    assert err == "", err


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0 and "dprime_2afc" in df.columns


def test_only_matrix_results_lack_sql():
    assert set(queries()) - set(SQL) - NO_SQL == {"v11_alignment"}
