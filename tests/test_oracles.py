"""Every registered query against its DuckDB twin over the whole small tables."""

import pytest

from checks.compare import connect, differences
from checks.oracles import all_sql
from checks.queries import registered

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_its_twin(spark, duck, name):
    mine = registered()[name](spark, FOLDER).toPandas()
    assert differences(mine, duck.execute(all_sql()[name]).df()) is None


def test_every_query_has_a_twin():
    assert set(registered()) == set(all_sql())


def test_entry_runs(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.queries()) >= set(__spark_entry__.oracle_sql())
