"""Random Fourier features are the plain sums, rounded alike, and are made in batches; classes are fitted side by side."""

import math

import numpy as np

from frond.operators import ml


def test_fourier_features_in_batches(spark):
    rows = [(1, 0.25, -1.5, 3.0), (2, 1e-9, 7.0, -0.125), (3, None, 1.0, 2.0)]
    df, names = ml.fourier(spark.createDataFrame(rows, "id long, a double, b double, c double"), ["a", "b", "c"], 0.5, 4)
    rng = np.random.default_rng(7)
    w, b = rng.normal(0, 1.0, (3, 4)), rng.uniform(0, 2 * np.pi, 4)
    got = {r.id: [r[n] for n in names] for r in df.collect()}
    for k, *x in rows[:2]:
        for j in range(4):
            s = b[j]
            for i in range(3):
                s += x[i] * w[i, j]
            assert math.isclose(got[k][j], math.cos(s) * math.sqrt(0.5), rel_tol=0, abs_tol=1e-15)
    assert got[3] == [None] * 4
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()  # no lambda for each product
    assert ml.margins().getStages()[1].getParallelism() > 1 and ml.boosted().getStages()[1].getParallelism() > 1
