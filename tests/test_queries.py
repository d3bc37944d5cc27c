import pytest

from tests import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", sorted(compare.contract.oracle_sql()))
def test_against_sql(spark, con, name):
    assert compare.compare(spark, con, FOLDER, name) is None


@pytest.mark.parametrize("name", sorted(set(compare.contract.queries()) - set(compare.contract.oracle_sql())))
def test_runs(spark, name):
    assert compare.contract.queries()[name](spark, FOLDER).collect()


def test_entry(spark):
    df = compare.contract.entry(spark)
    assert df.columns == ["split", "pos", "input", "output"] and df.count() > 0
