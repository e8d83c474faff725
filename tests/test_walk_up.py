import pytest

from tidewell.operators.graphs import walk_up


def test_walks_to_the_root_of_a_deep_chain(spark):
    parents = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 15)], "node long, parent long")
    assert sorted(map(tuple, walk_up(parents).collect())) == sorted((n, a, n - a) for n in range(1, 15) for a in range(1, n + 1))


def test_a_cycle_raises(spark):
    with pytest.raises(ValueError, match="cycle"):
        walk_up(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node long, parent long"))
