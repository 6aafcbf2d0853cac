"""Message passing over the account graph as joins and grouped averages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schema
from ..functions.scalars import clip, finite_or_zero, half_even
from ..session import materialize
from .skew import spread_join


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both nodes. Hub ids on either side are cut into slices."""
    ids = nodes.select("node_id")
    ends = edges.select("src_node_id", "dst_node_id")
    both = F.concat_ws("|", "src_node_id", "dst_node_id")
    for side in ("src_node_id", "dst_node_id"):
        ends = spread_join(ends, ids.select(F.col("node_id").alias(side)), [side], both, how="inner")
    return ends


def message_edges(nodes: DataFrame, transfers: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """All directed messages: each edge, each edge reversed, one loop per node. A bag: an edge
    that occurs twice counts twice in the mean."""
    edges = transfers.select("src_node_id", "dst_node_id")
    if derived is not None:
        edges = edges.unionAll(derived.select("src_node_id", "dst_node_id"))
    edges = known_edges(edges, nodes)
    reverse = edges.select(F.col("dst_node_id").alias("src_node_id"), F.col("src_node_id").alias("dst_node_id"))
    loops = nodes.select(F.col("node_id").alias("src_node_id"), F.col("node_id").alias("dst_node_id"))
    return edges.unionAll(reverse).unionAll(loops)


def feature_statistics(nodes: DataFrame, columns: Sequence[str] = schema.ACCOUNT_FEATURES) -> DataFrame:
    """Mean and population deviation per column, one row: the stored scaler."""
    clean = nodes.select(*[_present(nodes, c).alias(c) for c in columns])
    return clean.agg(*[f(c).alias(f"{p}_{c}") for c in columns
                       for p, f in (("mean", F.avg), ("dev", F.stddev_pop))])


def _present(nodes: DataFrame, column: str) -> Column:
    # a feature the table does not carry counts as zero
    return finite_or_zero(F.col(column)) if column in nodes.columns else F.lit(0.0)


def standardize(nodes: DataFrame, statistics: DataFrame,
                columns: Sequence[str] = schema.ACCOUNT_FEATURES) -> DataFrame:
    """node_id and the scaled columns; a constant column becomes zero."""
    both = nodes.crossJoin(F.broadcast(statistics))  # one row
    scaled = [((_present(nodes, c) - F.col(f"mean_{c}"))
               / F.when(F.col(f"dev_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"dev_{c}"))).alias(c) for c in columns]
    return both.select("node_id", *scaled)


def neighbour_mean(edges: DataFrame, vectors: DataFrame, columns: Sequence[str], prefix: str = "n_",
                   heavy: DataFrame | None = None) -> DataFrame:
    """Per node the mean of its senders' vectors; nodes without messages get zeros.

    A sender with very many messages is cut into slices for the join; receivers are averaged
    with partial sums before the shuffle. `heavy` holds the busy senders, if they are known.
    """
    senders = vectors.select(F.col("node_id").alias("src_node_id"), *columns)
    sent = spread_join(edges, senders, ["src_node_id"], F.col("dst_node_id"), how="inner", heavy=heavy)
    means = sent.groupBy(F.col("dst_node_id").alias("node_id")).agg(
        *[F.avg(c).alias(f"{prefix}{c}") for c in columns])
    return vectors.join(means, "node_id", "left").fillna(0.0, [f"{prefix}{c}" for c in columns])


WIDE = 2048  # products beyond this go through Arrow batches instead of one expression


def dense(df: DataFrame, keep: Sequence[str], inputs: Sequence[str], weights, bias,
          prefix: str) -> DataFrame:
    """keep + `prefix`0.. with W x + b; W has one row per output.

    Narrow layers are sums of products inside generated code; wide ones one matrix product per
    Arrow batch.
    """
    if len(inputs) * len(bias) > WIDE:
        return _dense_batches(df, keep, inputs, weights, bias, prefix)
    out = []
    for i, (row, b) in enumerate(zip(weights, bias)):
        total = F.lit(float(b))
        for name, w in zip(inputs, row):
            total = total + F.lit(float(w)) * F.col(name)
        out.append(total.alias(f"{prefix}{i}"))
    return df.select(*keep, *out)


def _dense_batches(df, keep, inputs, weights, bias, prefix):
    matrix, offset = np.asarray(weights, dtype=float).T, np.asarray(bias, dtype=float)
    kept, wanted = list(keep), list(inputs)

    def apply(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.names.index(c)) for c in wanted]
            # a NULL input makes every output NULL and a NaN stays NaN, as in the narrow form
            empty = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
            values = np.column_stack([c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]) @ matrix + offset
            out = [batch.column(batch.schema.names.index(k)) for k in kept]
            out += [pa.array(values[:, i], pa.float64(), mask=empty) for i in range(values.shape[1])]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, *(f"{prefix}{i}" for i in range(values.shape[1]))])

    picked = df.select(*kept, *wanted)
    schema_out = T.StructType([picked.schema[k] for k in kept]
                              + [T.StructField(f"{prefix}{i}", T.DoubleType()) for i in range(len(offset))])
    return picked.mapInArrow(apply, schema_out)


def relu(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def sage_layer(vectors: DataFrame, columns: Sequence[str], edges: DataFrame, layer: dict,
               prefix: str, activate: bool = True) -> DataFrame:
    """W_self x + b_self + W_neigh mean + b_neigh, then relu. `layer` holds the four arrays."""
    width = len(layer["b_neigh"])
    bias = [a + b for a, b in zip(layer["b_self"], layer["b_neigh"])]
    if width < len(columns):
        # the mean of products is the product of the mean: messages carry the narrow side
        sent = dense(vectors, ["node_id", *columns], columns, layer["w_neigh"], [0.0] * width, "_w")
        joined = neighbour_mean(edges, sent, names("_w", width)).drop(*names("_w", width))
        weights = [[*a, *[float(i == j) for j in range(width)]] for i, a in enumerate(layer["w_self"])]
        out = dense(joined, ["node_id"], [*columns, *names("n__w", width)], weights, bias, prefix)
    else:
        joined = neighbour_mean(edges, vectors, columns)
        weights = [list(a) + list(b) for a, b in zip(layer["w_self"], layer["w_neigh"])]
        out = dense(joined, ["node_id"], [*columns, *[f"n_{c}" for c in columns]], weights, bias, prefix)
    if not activate:
        return out
    return out.select("node_id", *[relu(F.col(c)).alias(c) for c in names(prefix, len(bias))])


def names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def embeddings(vectors: DataFrame, columns: Sequence[str], edges: DataFrame, model: dict, store=materialize) -> DataFrame:
    """Two layers: node_id and e0 .. e{h-1}. The first is stored: the second reads it twice."""
    vectors = store(vectors.select("node_id", *columns), "vectors")
    hidden = store(sage_layer(vectors, columns, edges, model["layer1"], "h"), "hidden")
    width = len(model["layer1"]["b_self"])
    return sage_layer(hidden, names("h", width), edges, model["layer2"], "e")


def account_probability(embedded: DataFrame, model: dict) -> DataFrame:
    """Dense layer, relu, two logits, softmax of the second."""
    width = len(model["head"]["b"])
    middle = dense(embedded, ["node_id"], names("e", len(model["layer2"]["b_self"])),
                   model["head"]["w"], model["head"]["b"], "m")
    middle = middle.select("node_id", *[relu(F.col(c)).alias(c) for c in names("m", width)])
    logits = dense(middle, ["node_id"], names("m", width), model["out"]["w"], model["out"]["b"], "z")
    return logits.select("node_id", (1 / (1 + F.exp(F.col("z0") - F.col("z1")))).alias("probability"))


def score_table(probabilities: DataFrame) -> DataFrame:
    p = clip(F.col("probability"), 0.0, 1.0)
    return probabilities.select(
        F.col("node_id").alias("account_id_hash"), p.alias("gnn_fraud_probability"),
        half_even(p * 100, 0).cast("int").alias("gnn_risk_score"))


def score_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("rows"),
                      F.avg("gnn_fraud_probability").alias("mean_gnn_fraud_probability"),
                      F.max("gnn_fraud_probability").alias("max_gnn_fraud_probability"))


def expiring_scores(scores: DataFrame, now: Column, ttl_seconds: int = 7200) -> DataFrame:
    """Key, text value and expiry time, ready for a key-value sink."""
    return scores.select(
        F.concat(F.lit("gnn:score:"), F.col("account_id_hash")).alias("key"),
        F.format_string("%.6f", "gnn_fraud_probability").alias("value"),
        F.timestamp_micros(F.unix_micros(now) + ttl_seconds * 1_000_000).alias("expires_at"))


def class_weights(nodes: DataFrame, label: str = "node_label") -> DataFrame:
    """total / max(count, 1) per class, divided by the mean over both classes."""
    counts = nodes.agg(*[F.sum(F.when(F.col(label) == k, 1).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    total = F.col("n0") + F.col("n1")
    raw = [total / F.greatest(F.col(f"n{k}"), F.lit(1)) for k in (0, 1)]
    mean = (raw[0] + raw[1]) / 2
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("label"), (raw[k] / mean).alias("weight")) for k in (0, 1)])).alias("w")
    ).select("w.label", "w.weight")
