import pytest

from strictbefore.llm import queries
from tests.compare import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    got, want = spark_rows(queries.QUERIES[name](spark, SF)), duck_rows(queries.ORACLE_SQL[name], SF)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
