import pytest

from strictbefore.plans import library
from tests.compare import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(library.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    got, want = spark_rows(library.QUERIES[name](spark, SF)), duck_rows(library.ORACLE_SQL[name], SF)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert library.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0  # fits need more matches than the smallest tables have


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
