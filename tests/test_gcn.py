import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import gcn, metrics, shares
from graphloom.operators import vectors as V
from graphloom.plans.prepared import PreparedGraph

N, D, H, C, T = 12, 4, 3, 3, 2


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, D))
    a = (rng.random((N, N)) < 0.3).astype(float)
    a = np.triu(a, 1) + np.triu(a, 1).T
    y = rng.integers(0, C, N)
    v = spark.createDataFrame([(i, i % T, [float(f) for f in x[i]], int(y[i])) for i in range(N)], "vid long, tid long, feature array<double>, label int")
    e = spark.createDataFrame([(int(i), int(j), 1) for i, j in zip(*np.nonzero(a))], "src long, dst long, weight long")
    return PreparedGraph(v, e, T), x, a, y


def plain(x, a, w0, w1):
    s = 1 / np.sqrt(a.sum(0) + 1)
    hat = s[:, None] * (a + np.eye(N)) * s[None, :]
    z0 = hat @ x @ w0
    z1 = hat @ np.maximum(z0, 0) @ w1
    p = np.exp(z1 - z1.max(1, keepdims=True))
    return hat, z0, z1, p / p.sum(1, keepdims=True)


def weights():
    return [V.glorot_weights(D, H), V.glorot_weights(H, C)]


def array(df, col="h"):
    return np.array([r[col] for r in sorted(df.collect(), key=lambda r: r["vid"])])


@pytest.mark.parametrize("kernel", ["optimized", "delayed"])
def test_forward_equals_numpy(toy, kernel):
    g, x, a, _ = toy
    w = weights()
    assert np.allclose(array(gcn.forward(g, w, kernel)[-1]), plain(x, a, *map(np.array, w))[2])
    assert np.allclose(array(gcn.predict(g, w), "p"), plain(x, a, *map(np.array, w))[3])


def test_product_and_propagation_commute(toy):
    g, *_ = toy
    one, two = (array(gcn.layer(g, gcn.features(g), weights()[0], o)) for o in ("matmul_first", "propagate_first"))
    assert np.allclose(one, two)


def test_full_gradient_is_the_derivative(toy):
    g, x, a, y = toy
    w = [np.array(m) for m in weights()]
    on = np.zeros(N, bool)
    for t in range(T):
        ids = np.arange(t, N, T)
        on[ids[: int(len(ids) * 0.5)]] = True

    def loss(w0, w1, tile):
        p = plain(x, a, w0, w1)[3]
        return -np.log(p[on, y[on]]).sum()

    got = gcn.gradients(g, weights(), 0.5, "full")
    n = int(N / T * 0.5)
    for k in range(2):
        d = np.zeros_like(w[k])
        for r in got[k].collect():
            d[r["i"], r["j"]] += r["w"] * n
        for i, j in ((0, 0), (1, 2), (2, 1)):
            up, down = [m.copy() for m in w], [m.copy() for m in w]
            up[k][i, j] += 1e-5
            down[k][i, j] -= 1e-5
            assert d[i, j] == pytest.approx((loss(*up, 0) - loss(*down, 0)) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("kernel", ["original", "delayed"])
def test_gradients_of_sums_equal_numpy(toy, kernel):
    g, x, a, y = toy
    w0, w1 = map(np.array, weights())
    s = 1 / np.sqrt(a.sum(0) + 1)
    between = s[:, None] * a * s[None, :]
    ahead, back = (between + np.diag(s), between + np.eye(N)) if kernel == "original" else (plain(x, a, w0, w1)[0],) * 2
    a0 = ahead @ (s[:, None] * x if kernel == "original" else x)
    z0 = a0 @ w0
    a1 = ahead @ np.maximum(z0, 0)
    p = np.exp(a1 @ w1)
    error = p / p.sum(1, keepdims=True) - np.eye(C)[y]
    for t in range(T):
        off = np.ones(N, bool)
        off[np.arange(t, N, T)[: int(N / T * 0.5)]] = False
        error[off & (np.arange(N) % T == t)] = 0
    down = (back @ (error @ w1.T)) * (z0 > 0)
    for k, (left, right) in enumerate(((a0, down), (a1, error))):
        for r in gcn.gradients(g, weights(), 0.5, kernel=kernel, first=k)[0].collect():
            own = np.arange(N) % T == r["tid"]
            assert r["w"] == pytest.approx((left[own].T @ right[own])[r["i"], r["j"]] / int(N / T * 0.5), abs=1e-9)


def test_training_lowers_the_loss(toy):
    g, *_ = toy
    config = gcn.GcnConfig(input_dim=D, hidden_dim=H, num_labels=C, learning_rate=0.3, train_ratio=0.5)
    before = metrics.cross_entropy(gcn.predict(g, config.weights()), g).agg(F.avg("loss")).first()[0]
    after = metrics.cross_entropy(gcn.predict(g, gcn.train(g, config, 3)), g).agg(F.avg("loss")).first()[0]
    assert after < before


def test_shares_reconstruct_and_add(spark):
    rows = [(i, k, v) for i, k, v in ((0, 0, 1.5), (1, 0, -2.25), (2, 1, 0.0), (3, 1, 1000.125), (4, 2, -0.5))]
    df = shares.split(spark.createDataFrame(rows, "vid long, k long, x double"))
    got = df.select("x", shares.reconstruct(F.col("share0"), F.col("share1")).alias("y")).collect()
    assert all(r.x == r.y for r in got)
    total = df.agg(shares.ring_sum(F.col("share0")).alias("a"), shares.ring_sum(F.col("share1")).alias("b"))
    assert total.select(shares.reconstruct(F.col("a"), F.col("b"))).first()[0] == sum(r[2] for r in rows)


def test_scalars(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (5,), (8,)], "n long")
    n = F.col("n")
    got = df.select(S.integer_log2(n), S.next_power_of_two(n), S.is_power_of_two(n), S.inverse_root(n), S.encode_fixed(n * -0.3, 4)).collect()
    assert [(*r[:3], round(r[3], 12), r[4]) for r in got] == [(0, 1, False, 0.0, 0), *((*x, round(y**-0.5, 12), z) for x, y, z in (((0, 1, True), 2, -4), ((1, 2, True), 3, -9), ((2, 8, False), 6, -24), ((3, 8, True), 9, -38)))]
    assert df.limit(1).select(S.tokens(F.lit(" a,b  c,"), " ,")).first()[0] == ["a", "b", "c"]
