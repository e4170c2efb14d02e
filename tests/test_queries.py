import pytest

from tallyforge.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    assert not differences(spark, SF, QUERIES[name], ORACLE_SQL[name])
