"""Training against finite differences and a plain step."""

import numpy as np
import pytest

from framelake.operators import networks, training


def plain_loss(image, label, weights):
    conf = networks.forward(image[None], weights)[0]
    return -np.log(conf if label else 1 - conf)


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    weights = networks.even_weights()
    batch, labels = rng.random((3, 24, 24)), np.array([1.0, 0.0, 1.0])
    loss, right, g = training.gradients(batch, labels, weights)
    assert loss == pytest.approx(sum(plain_loss(b, y, weights) for b, y in zip(batch, labels, strict=True))) and 0 <= right <= 3
    values = training.flat(weights)
    ends = np.cumsum([k.size for k in weights.kernels] + [weights.dense[0].size, weights.dense[1].size, weights.head[0].size, 1])
    for at in [int(k) for a, b in zip([0, *ends], ends, strict=False) for k in rng.integers(a, b, 4)]:
        step = np.zeros_like(values)
        step[at] = 1e-6
        up, down = (sum(plain_loss(b, y, training.shaped(values + s, weights)) for b, y in zip(batch, labels, strict=True)) for s in (step, -step))
        assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        image = rng.integers(0, 60, (24, 24))
        if i % 2:
            image[6:18, 6:18] += 150
        rows.append((i, bytearray(image.astype(np.uint8).tobytes()), i % 2))
    return rows, spark.createDataFrame([*rows, (99, None, 1), (98, bytearray(b"short"), 1), (97, rows[0][1], None)], "id long, pixels binary, label int").repartition(5)


def test_one_step_is_the_plain_step(windows, monkeypatch):
    rows, df = windows
    monkeypatch.setattr(training, "FAN", 2)  # several merges
    weights = networks.even_weights()
    got = training.train(df, weights, steps=1, rate=0.01)
    batch = np.array([np.frombuffer(p, dtype=np.uint8).reshape(24, 24) / 255.0 for _, p, _ in rows])
    loss, right, g = training.gradients(batch, np.array([y for *_, y in rows], dtype=float), weights)
    g = np.clip(g / len(rows), -5, 5)
    want = training.flat(weights) - 0.01 * g / (np.abs(g) + 1e-8)
    assert np.abs(training.flat(got.weights) - want).max() < 1e-6
    assert got.history == [(0, pytest.approx(loss / 60), pytest.approx(right / 60))]


def test_training_lowers_the_loss_and_is_saved(windows):
    _, df = windows
    got = training.train(df, networks.even_weights(), steps=12, rate=0.02, turns=2)
    assert got.history[-1][1] < 0.7 * got.history[0][1]
    back = networks.read_weights(networks.write_weights(got.weights))
    assert np.allclose(training.flat(back), training.flat(got.weights), atol=1e-6)
    same = training.train(df.where("false"), got.weights, steps=2)
    assert same.history == [] and np.array_equal(training.flat(same.weights), training.flat(got.weights))
