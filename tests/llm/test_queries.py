import pytest

from codeloom.llm import catalogue

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.exists(DIRECTORY), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, DIRECTORY).count() > 0
