"""Training of the account network against a plain NumPy version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import propagate
from tallyrisk.plans import network
from tallyrisk.session import fresh_path, materialize

NAMES = ["a", "b", "c"]


def small_graph(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    label = (x[:, 0] + rng.normal(size=n) > 0.8).astype(int)
    split = ["train" if i < 40 else "val" if i < 52 else "test" for i in range(n)]
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n - 2, (90, 2))] + [(0, int(b)) for b in rng.integers(0, n - 2, 40)]
    pairs += pairs[:5]  # a bag: repeated edges count again; the last nodes have no edges
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)], "node_id string")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src_node_id string, dst_node_id string")
    vectors = spark.createDataFrame([(f"n{i}", *map(float, r)) for i, r in enumerate(x)], "node_id string, a double, b double, c double")
    labels = spark.createDataFrame([(f"n{i}", int(k), s) for i, (k, s) in enumerate(zip(label, split))], "node_id string, label int, split string")
    mean = np.eye(n)
    for a, b in pairs:
        mean[b, a] += 1
        mean[a, b] += 1
    mean /= mean.sum(axis=1, keepdims=True)
    messages = propagate.message_edges(nodes, edges)
    return network.prepare(vectors.repartition(3), messages, labels, NAMES), vectors, messages, x, label, np.array(split), mean


def plain_training(x, label, split, mean, keys, t):
    """The same network with one dense matrix of means and the chain rule written out."""
    w, m, v, history = network.first_weights(x.shape[1], t), {}, {}, []
    train = split == "train"
    counts = np.bincount(label[train], minlength=2)
    weight = counts.sum() / np.maximum(counts, 1)
    weight = (weight / weight.mean())[label] * train
    relu = lambda z: np.maximum(z, 0)

    def forward(epoch):
        masks = [network.mask(keys, k, epoch, layer, t) for layer, k in ((1, t.hidden), (2, t.hidden), (3, t.hidden // 2))]
        z1 = x @ w["s1"].T + w["s1_b"] + mean @ x @ w["n1"].T + w["n1_b"]
        h = relu(z1) * masks[0]
        z2 = h @ w["s2"].T + w["s2_b"] + mean @ h @ w["n2"].T + w["n2_b"]
        e = relu(z2) * masks[1]
        z3 = e @ w["head"].T + w["head_b"]
        r = relu(z3) * masks[2]
        z4 = r @ w["out"].T + w["out_b"]
        p = np.exp(z4) / np.exp(z4).sum(axis=1, keepdims=True)
        return masks, z1, h, z2, e, z3, r, p

    for epoch in range(t.epochs):
        masks, z1, h, z2, e, z3, r, p = forward(epoch)
        history.append(-(weight * np.log(p[np.arange(len(x)), label])).sum() / weight.sum())
        d4 = (p - np.eye(2)[label]) * weight[:, None] / weight.sum()
        d3 = d4 @ w["out"] * masks[2] * (z3 > 0)
        d2 = d3 @ w["head"] * masks[1] * (z2 > 0)
        d1 = (d2 @ w["s2"] + mean.T @ (d2 @ w["n2"])) * masks[0] * (z1 > 0)
        g = {"out": d4.T @ r, "out_b": d4.sum(0), "head": d3.T @ e, "head_b": d3.sum(0), "s2": d2.T @ h, "s2_b": d2.sum(0),
             "n2": d2.T @ (mean @ h), "n2_b": d2.sum(0), "s1": d1.T @ x, "s1_b": d1.sum(0), "n1": d1.T @ (mean @ x), "n1_b": d1.sum(0)}
        for k in w:
            m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
            v[k] = 0.999 * v.get(k, 0) + 0.001 * g[k] ** 2
            step = m[k] / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(v[k] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
            w[k] = w[k] * (1 - t.rate * t.decay) - t.rate * step
    return w, history, forward(-1)[-1][:, 1]


@pytest.mark.parametrize("dropout", [0.0, 0.25])
def test_weights_equal_the_plain_version(spark, dropout):
    graph, vectors, messages, x, label, split, mean = small_graph(spark)
    t = network.Training(hidden=6, epochs=5, rate=0.01, decay=0.01, dropout=dropout, patience=99)
    keys = {r["node_id"]: r["key"] for r in graph.nodes.select("node_id", "key").collect()}
    w, losses, p = plain_training(x, label, split, mean, np.array([keys[f"n{i}"] for i in range(len(x))]), t)
    model, scores = network.train(graph, t)
    assert np.allclose([h["loss"] for h in model.history], losses, atol=1e-9)
    best = int(np.argmax([h["val_pr_auc"] for h in model.history]))
    if best == t.epochs - 1:
        assert max(np.abs(w[k] - model.weights[k]).max() for k in w) < 1e-8
        got = {r["node_id"]: r["probability"] for r in scores.collect()}
        assert max(abs(got[f"n{i}"] - p[i]) for i in range(len(x))) < 1e-8
    else:  # the kept epoch is an earlier one: train up to it
        short = network.Training(**{**t.__dict__, "epochs": best + 1})
        w, _, p = plain_training(x, label, split, mean, np.array([keys[f"n{i}"] for i in range(len(x))]), short)
        assert max(np.abs(w[k] - model.weights[k]).max() for k in w) < 1e-8
    # saved, reloaded and applied by the general operators
    path = fresh_path(spark, "network")
    model.save(path)
    again = network.Network.load(path)
    assert again.history == model.history and again.settings == t
    fresh = {r["node_id"]: r["probability"] for r in again.score(vectors, messages).collect()}
    kept = {r["node_id"]: r["probability"] for r in scores.collect()}
    assert max(abs(fresh[k] - kept[k]) for k in kept) < 1e-9 and len(fresh) == len(kept)


def test_training_ends_without_progress(spark):
    graph, *_ = small_graph(spark)
    model, _ = network.train(graph, network.Training(hidden=4, epochs=30, rate=0.0, dropout=0.0, patience=2))
    assert len(model.history) == 3  # the first epoch is the best, two more bring nothing


def test_busy_accounts_are_cut(spark, monkeypatch):
    graph, *_ = small_graph(spark)
    t = network.Training(hidden=4, epochs=1, dropout=0.0)
    whole, _ = network.train(graph, t)
    from tallyrisk.operators.skew import heavy_keys
    graph.busy = materialize(heavy_keys(graph.edges, ["src_node_id"], rows_per_task=5), "busy")
    assert graph.busy.count() > 3
    cut, _ = network.train(graph, t)
    assert max(np.abs(whole.weights[k] - cut.weights[k]).max() for k in whole.weights) < 1e-10


def test_no_labelled_rows_change_nothing_but_the_decay(spark):
    graph, *_ = small_graph(spark)
    graph.nodes = graph.nodes.withColumn("split", F.lit("test"))
    model, scores = network.train(graph, network.Training(hidden=4, epochs=1, decay=0.0, dropout=0.0))
    first = network.first_weights(3, model.settings)
    assert all(np.abs(first[k] - model.weights[k]).max() < 1e-12 for k in first) and scores.count() == 60
