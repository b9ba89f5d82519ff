"""Seeds drawn in rounds, against k-means++."""

import numpy as np
import pytest

from orebody.operators import cluster


@pytest.mark.parametrize("k", [3, 12])
def test_as_good_as_plus_plus(spark, k):
    rng = np.random.default_rng(k)
    middles = rng.uniform(-50, 50, (k, 2))
    x = np.concatenate([rng.normal(m, 1.0, (80, 2)) for m in middles] + [np.full((400, 2), middles[0])])
    df = spark.createDataFrame([*map(tuple, x.tolist()), (None, 1.0)], "x double, y double").repartition(4).na.drop().cache()
    seeds = cluster.seed_in_rounds(df, ["x", "y"], k)
    assert len(seeds) == k
    ours = cluster.kmeans(df, ["x", "y"], seeds)[1][-1]
    theirs = min(cluster.kmeans(df, ["x", "y"], cluster.plus_plus(df, ["x", "y"], k, s))[1][-1] for s in (1, 2, 3))
    assert ours <= 1.05 * theirs
    df.unpersist()


def test_few_distinct_rows(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (5.0,), (None,)], "x double")
    assert sorted(cluster.seed_in_rounds(df, ["x"], 4)) == [[1.0], [5.0]]
    assert cluster.seed_in_rounds(df.limit(0), ["x"], 4) == []
