import pytest

from agendula.llm import queries as Q

from ..oracle import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, Q.QUERIES[name], Q.SQL[name], SF, connect(SF)) == []


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in Q.QUERIES] == list(range(1, 14))
