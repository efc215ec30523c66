"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from driftwood.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_agrees_with_sql(spark, duck, name):
    result = QUERIES[name](spark, SF)
    if name in SQL:
        assert differences(result, duck, SQL[name]) is None
    else:
        assert result.count() > 0


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() == 16 * 200


def test_every_operator_is_registered():
    wanted = [f"s{i}" for i in range(1, 10)] + [f"f{i}" for i in range(1, 15)] + [f"j{i}" for i in range(1, 10)]
    wanted += [f"a{i}" for i in range(1, 17)] + [f"w{i}" for i in range(1, 11)] + [f"r{i}" for i in range(8)]
    wanted += ["u1", "u2", "e1"] + [f"c{i}" for i in range(1, 17)] + [f"x{i}" for i in range(1, 15)]
    assert {q.split("_")[0] for q in REGISTRY} == set(wanted)
