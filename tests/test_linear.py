"""The kernel machine against an exact one, and folds fitted together against folds fitted apart."""

import numpy as np
from pyspark.sql import functions as F

from orebody.operators import classify, linear


def rings(n, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    r, a = 1 + y + rng.normal(0, 0.18, n), rng.uniform(0, 2 * np.pi, n)
    return np.column_stack([r * np.cos(a), r * np.sin(a)]), y


def exact_machine(x, y, new, gamma):
    """The same objective with the exact kernel: features are rows of a square root of the kernel matrix."""
    kernel = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(axis=2))
    values, vectors = np.linalg.eigh(kernel(x, x) + 1e-9 * np.eye(len(x)))
    root = vectors / np.sqrt(values)
    a, b = kernel(x, x) @ root, kernel(new, x) @ root
    w = np.zeros((a.shape[1] + 1, 3))
    for _ in range(4_000):  # plain gradient steps
        _, slope = linear.squared_hinge(a @ w[:-1] + w[-1], y)
        grad = np.concatenate([a.T @ slope, slope.sum(axis=0, keepdims=True)]) / len(x)
        grad[:-1] += w[:-1] / len(x)
        w -= 0.4 * grad
    return (b @ w[:-1] + w[-1]).argmax(axis=1)


def test_kernel_machine_against_an_exact_one(spark):
    x, y = rings(300)
    new, truth = rings(300, seed=4)
    frame = lambda a, b: spark.createDataFrame([(float(p), float(q), float(c)) for (p, q), c in zip(a, b)], "a double, b double, y double").repartition(3)
    _, scored = classify.fit_predict("svm_rbf", frame(x, y), frame(new, truth), ["a", "b"], "y")
    got = {(r["a"], r["b"]): r["prediction"] for r in scored.collect()}
    ours = np.array([got[tuple(p)] for p in new.tolist()])
    gamma = 1 / (2 * x.var(axis=0).mean())
    exact = exact_machine(x, y, new, gamma)
    assert (exact == truth).mean() > 0.9 and abs((ours == truth).mean() - (exact == truth).mean()) < 0.03
    assert (ours == exact).mean() > 0.95


def test_folds_together_and_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 4), float(i % 3), [float(v) for v in rng.normal(i % 3, 1.0, 5)]) for i in range(240)]
    df = spark.createDataFrame([*rows, (999, 1, None, [0.0] * 5), (998, 1, 1.0, None)], "id long, fold int, y double, x array<double>").repartition(2)
    for loss in (linear.squared_hinge, linear.softmax):
        model = linear.fit_folds(df, "x", "y", "fold", loss, steps=60)
        assert model.folds == [0, 1, 2, 3] and model.classes == [0.0, 1.0, 2.0]
        alone = linear.fit_folds(df.where("fold <> 2"), "x", "y", None, loss, steps=60)
        assert np.abs(model.weights[2] - alone.weights[0]).max() < 0.02
        hit = df.where("x is not null").withColumn("p", model.predict(F.col("x"), F.col("fold"))).where("p = y").count()
        assert hit > 150


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    s, y = rng.normal(size=(20, 4)), rng.integers(0, 4, 20)
    for loss in (linear.squared_hinge, linear.softmax):
        base, slope = loss(s, y)
        for k in range(4):
            moved = s.copy()
            moved[:, k] += 1e-6
            assert np.allclose((loss(moved, y)[0] - base) / 1e-6, slope[:, k], atol=1e-4)


def test_neighbours_apart(spark):
    rows = [(i, i % 2, float(i // 10), [float(i // 10), float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, fold int, y double, v array<double>")
    got = {r["id"]: r["prediction"] for r in classify.nearest_neighbours(df, df, "id", "v", "y", k=1, apart="fold").collect()}
    for i, f, _, v in rows:
        near = min((r for r in rows if r[1] != f), key=lambda r: (round(float(np.linalg.norm(np.subtract(r[3], v))), 9), r[0]))
        assert got[i] == near[2]
