"""Networks, pixel and sound kernels, evolution, and streams against batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mlquarry.media import audio, images, mapped
from mlquarry.neural import evolution, training
from mlquarry.neural.modules import AvgPool2D, BatchNorm1d, Conv2D, CrossAttention, Dropout, Flatten, Function, Linear, MaxPool2D, RNN, Sequential, mlp
from mlquarry.neural.tensor import Tensor, bce_loss, concatenate, cross_entropy_loss, distillation_loss, gelu, huber_loss, mae_loss, mse_loss, numerical_gradient, sigmoid, softmax, stack
from mlquarry.operators import lifecycle
from mlquarry.streaming import windows

OWN = np.random.default_rng(0)


def check(f, x):
    t = Tensor(x, requires_grad=True)
    f(t).backward()
    assert np.allclose(t.grad, numerical_gradient(lambda v: f(Tensor(v)).item(), x), atol=1e-6)


def test_gradients_of_operations():
    x, w = OWN.normal(size=(3, 4)), Tensor(OWN.normal(size=(4, 2)))
    check(lambda t: ((t @ w) ** 2.0).sum(), x)
    check(lambda t: (t / (t * t + 1) - 2 * t).mean(), x)
    check(lambda t: (1 / (abs(t) + 1)).sum(axis=0, keepdims=True).sum(), x)
    check(lambda t: (concatenate([t, t * 2], 1)[:, 2:6].reshape((6, 2)).T ** 2.0).sum(), x)
    check(lambda t: stack([gelu(t), sigmoid(t)]).exp().log().sum(), x)
    check(lambda t: (softmax(t) * np.arange(4)).sum(), x)
    check(lambda t: (t + Tensor(np.ones(4))).sum() * (3 - t).sum(), x)


def test_gradients_of_losses():
    x, y = OWN.normal(size=(3, 4)), OWN.normal(size=(3, 4))
    for loss in (mse_loss, mae_loss, huber_loss):
        check(lambda t, loss=loss: loss(t, y), x)
    check(lambda t: bce_loss(sigmoid(t), (y > 0) * 1.0), x)
    check(lambda t: cross_entropy_loss(t, np.array([0, 3, 1])), x)
    check(lambda t: cross_entropy_loss(t, np.full((3, 4), 0.25)), x)
    check(lambda t: distillation_loss(t, y, np.array([0, 3, 1])), x)


def test_gradients_of_layers():
    picture = OWN.normal(size=(2, 2, 5, 5))
    for layer in (Sequential(Conv2D(2, 3, 3, 2, 1), MaxPool2D(2, 1), Flatten(), Linear(12, 2)), Sequential(AvgPool2D(2, 1, 1), Function("tanh"))):
        check(lambda t, layer=layer: (layer(t) ** 2.0).sum(), picture)
    check(lambda t: (BatchNorm1d(4)(t) ** 3.0).sum(), OWN.normal(size=(6, 4)))
    for cell in ("rnn", "lstm", "gru"):
        check(lambda t, cell=cell: (RNN(3, 2, 2, cell)(t) ** 2.0).sum(), OWN.normal(size=(4, 2, 3)))
    check(lambda t: CrossAttention(3, 4, 5)(t, Tensor(np.ones((2, 4)))).sum(), OWN.normal(size=(3, 3)))


def test_tensor_rules():
    with pytest.raises(ValueError):
        Tensor([1.0, 2.0], True).backward()
    with pytest.raises(ValueError):
        Tensor([1.0, 2.0]).item()
    a = Tensor([2.0], True)
    b = a * a + a
    b.backward()
    assert a.grad == 5.0 and len(b.graph()[0]) == 3
    with pytest.raises(ValueError):
        Dropout(1.5)
    assert (Dropout(0.5).eval()(Tensor(np.ones(5))).data == 1).all()


def test_optimizers_reach_the_minimum():
    for make in (lambda p: training.SGD(p, 0.1, 0.5), lambda p: training.Adam(p, 0.1), lambda p: training.AdamW(p, 0.1, weight_decay=0.0), lambda p: training.RMSprop(p, 0.05)):
        p = Tensor([5.0], True)
        optimizer = make([p])
        for _ in range(200):
            optimizer.zero_grad()
            ((p - 2) ** 2.0).sum().backward()
            optimizer.step()
        assert p.data == pytest.approx([2.0], abs=0.1)


@pytest.fixture(scope="module")
def rows(spark):
    y = OWN.integers(0, 2, 120)
    x = OWN.normal(size=(120, 2)) + y[:, None] * 3
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(120)], "id long, v array<double>, y int").repartition(4)


def test_training_over_tasks_equals_one_batch(rows):
    loss = lambda p, t: cross_entropy_loss(p, t, "sum")
    model, same = mlp([2, 4, 2], seed=3), mlp([2, 4, 2], seed=3)
    trainer = training.Trainer(model, training.SGD(model.parameters(), 0.5), loss)
    trainer.fit(rows, "y", 1)
    every = rows.collect()
    x, y = np.array([r.v for r in every]), np.array([r.y for r in every])
    (loss(same(Tensor(x)), y) * (1 / 120)).backward()
    training.SGD(same.parameters(), 0.5).step()
    for a, b in zip(model.parameters(), same.parameters(), strict=True):
        assert np.allclose(a.data, b.data)
    history = trainer.fit(rows, "y", 15, rows, patience=5)
    assert history[-1]["val_loss"] < history[0]["loss"]
    out = trainer.predict(rows)
    assert out.where((F.element_at("output", 2) > F.element_at("output", 1)) == (F.col("y") == 1)).count() > 105


def test_federated_and_uncertainty(spark, rows):
    model = mlp([2, 1], seed=1)
    before = [p.data.copy() for p in model.parameters()]
    loss = lambda p, t: mse_loss(p, t.reshape(-1, 1), "sum")
    updates = training.federated_round(rows.withColumn("c", F.col("id") % 3), "c", "y", model, loss, 0.05, 3)
    training.updated(model, lifecycle.fedavg(updates))
    assert any((a != p.data).any() for a, p in zip(before, model.parameters(), strict=True))
    spread = training.mc_dropout(rows.limit(5), "id", mlp([2, 8, 1], dropout=0.5), 6).collect()
    assert len(spread) == 5 and any(r.variance > 0 for r in spread)
    plain = mlp([2, 8, 1], seed=4)
    want = {r.id: r.output[0] for r in training.forward(rows, plain).collect()}
    assert all(r["mean"] == pytest.approx(want[r.id]) and r.variance == pytest.approx(0, abs=1e-9) for r in training.mc_dropout(rows, "id", plain, 4).collect())


def test_explanations_and_attacks():
    model, x = mlp([3, 1], seed=2), OWN.normal(size=(2, 3))
    assert training.integrated_gradients(model, x, 0).sum(axis=1) == pytest.approx((model(Tensor(x)).data - model(Tensor(x * 0)).data)[:, 0])
    loss = lambda p, t: mse_loss(p, t)
    y = np.zeros((2, 1))
    inside = np.clip(x, 0.2, 0.8)
    for attack in (training.fgsm, training.pgd):
        moved = attack(model, inside, y, loss)
        assert np.abs(moved - inside).max() <= 0.03 + 1e-9 and loss(model(Tensor(moved)), y).item() > loss(model(Tensor(inside)), y).item()


def test_evolution(spark):
    population = evolution.Population(2, 1, evolution.Config(population_size=12, seed=1, add_node_rate=0.5, add_connection_rate=0.5))
    best = population.evolve(spark, evolution.xor_fitness, 2)
    assert 0 <= evolution.xor_fitness(best) <= 4 and len(population.genomes) == 12
    one = population.genomes[0]
    assert evolution.distance(one, one.copy()) == 0 and evolution.activate(one, np.ones((3, 2))).shape == (3, 1)
    found = evolution.search(spark, evolution.SearchSpace(), lambda a: -len(a), 12, batch=4)
    assert len(found) == 12 and found[0][0] == max(s for s, _ in found) == -1


def test_image_kernels(spark):
    x = OWN.integers(0, 256, (8, 8)).astype(float)
    assert (images.resize(x, (8, 8)) == x).all() and np.allclose(images.rotate(x, 0), x) and (images.flip(images.flip(x)) == x).all()
    square = np.array([[0, 0], [7, 0], [7, 7], [0, 7]], float)
    assert np.allclose(images.perspective(x, square, square), x)
    color = OWN.integers(0, 256, (4, 4, 3)).astype(float)
    assert np.allclose(images.hsv_to_rgb(images.rgb_to_hsv(color)), color) and np.allclose(images.hue(color, 360), color)
    assert np.allclose(images.gaussian_blur(np.full((6, 6), 7.0)), 7) and images.edges(np.full((6, 6), 7.0)).max() < 1e-9
    assert images.histogram(x).sum() == pytest.approx(1) and images.match_histogram(x, x) == pytest.approx(x)
    assert images.moments(np.eye(5))[1:3] == pytest.approx([2, 2]) and images.hog(x, 4).shape == (36,)
    step = np.zeros((8, 8))
    step[:, 4:] = 100
    u, _ = images.horn_schunck(step, np.roll(step, 1, axis=1), 1.0, 50)
    assert u[:, 3:6].mean() > 0
    df = spark.createDataFrame([(1, x.reshape(-1).tolist()), (2, None)], "id int, image array<double>")
    got = mapped(df, "image", lambda p: p.T, (8, 8)).orderBy("id").collect()
    assert got[0].out == x.T.reshape(-1).tolist() and got[1].out is None


def test_audio_kernels():
    tone = audio.sine(440, 0.5, 8000)
    assert audio.pitch(tone, 8000, 100, 1000) == pytest.approx(440, rel=0.02)
    assert audio.centroid(tone, 8000, 1024, 512).mean() == pytest.approx(440, rel=0.05)
    assert audio.chroma(tone, 8000).argmax(axis=1).tolist() == [0] * len(audio.chroma(tone, 8000))
    assert len(audio.resample(tone, 8000, 4000)) == len(tone) // 2 and len(audio.pitch_shift(tone, 3)) == len(tone)
    assert audio.mfcc(tone, 8000).shape[1] == 13 and audio.delta(np.ones((3, 2))).sum() == 0
    beat = np.zeros(8000)
    beat[::2000] = 1
    assert audio.tempo(beat, 4000, 100) == pytest.approx(120, rel=0.05)
    assert len(audio.onsets(np.concatenate([np.zeros(2000), tone]), 8000)) >= 1
    assert audio.frames(np.ones(3), 8, 4).shape == (1, 8)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "a" if m % 2 else "b", float(h * m)) for h in range(6) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "t string, k string, value double").withColumn("ts", F.to_timestamp("t"))
    df.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = windows.windowed(stream, "ts", "value", ["k"], "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(60)
    order = ["start", "k"]
    assert spark.table("w").orderBy(order).collect() == windows.windowed(df, "ts", "value", ["k"], "1 hour").orderBy(order).collect()
    windows.running_moments(stream, "value", ["k"], f"{tmp_path}/c2", f"{tmp_path}/m").awaitTermination(60)
    got = windows.merged(spark.read.parquet(f"{tmp_path}/m"), ["k"]).orderBy("k").collect()
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")).orderBy("k").collect()
    assert [tuple(map(pytest.approx, r[1:])) for r in want] == [tuple(r[1:]) for r in got]


def test_trainer_equals_plain_gradient_descent(spark, tmp_path):
    own = np.random.default_rng(0)
    x, w = own.normal(size=(60, 3)), np.array([1.0, -2.0, 0.5])
    df = spark.createDataFrame([(r.tolist(), float(r @ w + 1)) for r in x], "v array<double>, y double").repartition(5)
    loss = lambda p, t: ((p.reshape(-1) - Tensor(t)) ** 2).sum()
    made = lambda: Linear(3, 1)
    model = made()
    a, b = model.weight.data.copy(), model.bias.data.copy()
    trainer = training.Trainer(model, training.SGD(model.parameters(), 0.1, momentum=0.9), loss)
    assert training.Trainer.PARTS > 1
    trainer.fit(df, "y", epochs=4)
    y, moves = x @ w + 1, [0.0, 0.0]
    for _ in range(4):
        left = (x @ a.reshape(3, 1)).reshape(-1) + b.reshape(-1)[0] - y
        grads = [(2 * x.T @ left / 60).reshape(a.shape), np.full(b.shape, 2 * left.mean())]
        for i, g in enumerate(grads):
            moves[i] = 0.9 * moves[i] + g
        a, b = a - 0.1 * moves[0], b - 0.1 * moves[1]
    assert np.allclose(model.weight.data, a) and np.allclose(model.bias.data, b)
    path = str(tmp_path / "state.npz")
    trainer.save_checkpoint(path)
    again = made()
    other = training.Trainer(again, training.SGD(again.parameters(), 0.1, momentum=0.9), loss)
    other.load_checkpoint(path)
    trainer.fit(df, "y", epochs=2)
    other.fit(df, "y", epochs=2)
    assert all(np.allclose(p.data, q.data) for p, q in zip(model.parameters(), again.parameters(), strict=True)) and len(other.history) == 6
    batched = made()
    small = training.Trainer(batched, training.SGD(batched.parameters(), 0.05), loss)
    history = small.fit(df, "y", epochs=4, batch_size=15)
    assert history[-1]["loss"] < history[0]["loss"] / 2 and small.evaluate(df, "y") < history[0]["loss"]


def test_contrastive_learner_equals_the_batched_loss(spark):
    own = np.random.default_rng(5)
    x, y = own.normal(size=(9, 4)), own.normal(size=(9, 3))
    learner = training.ContrastiveLearner(mlp([4, 5], seed=1), mlp([3, 6], seed=2), 5, 6, dim=3)
    a, b = learner.embed(Tensor(x), "a").data, learner.embed(Tensor(y), "b").data
    assert np.allclose(np.linalg.norm(a, axis=1), 1) and np.allclose(np.linalg.norm(b, axis=1), 1)
    pairs = spark.createDataFrame([(0, i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(a, b, strict=True))], "batch int, k int, a array<double>, b array<double>")
    loss = learner(Tensor(x), Tensor(y))
    assert loss.item() == pytest.approx(lifecycle.contrastive_losses(pairs, "batch", "k", "a", "b").first().loss)
    optimizer, first = training.Adam(learner.parameters(), 0.05), loss.item()
    for _ in range(30):
        optimizer.zero_grad()
        learner(Tensor(x), Tensor(y)).backward()
        optimizer.step()
    assert learner(Tensor(x), Tensor(y)).item() < first / 2


def test_colour_histogram():
    frames = np.random.default_rng(0).integers(0, 256, (2, 3, 4, 3)).astype(float)
    got = images.color_histogram(frames, 16).reshape(3, 16)
    for c in range(3):
        assert np.allclose(got[c], np.bincount((frames[..., c].reshape(-1) // 16).astype(int), minlength=16) / 24)
