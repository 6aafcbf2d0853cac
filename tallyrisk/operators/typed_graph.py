"""The graph with four node types and typed relations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clip
from .propagate import dense, names, relu
from ..session import materialize
from .short_ids import packed, unpacked
from .skew import heavy_keys, spread_join

# relation -> (source type, target type)
RELATIONS = {
    "TRANSACTS_WITH": ("account", "account"),
    "USES_DEVICE": ("account", "device"),
    "ORIGINATES_FROM": ("account", "ip"),
    "TRANSACTS_AT": ("account", "merchant"),
}
FAN_OUT = [15, 10, 5]


def _num(name: str) -> Column:
    return F.col(name).cast("double")


def _log(name: str) -> Column:
    return F.log1p(_num(name))


def account_vector(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "node_id",
        _log("account_age_days").alias("account_age_log"),
        (_num("kyc_tier") / 3.0).alias("kyc_tier"),
        (_num("account_type") / 2.0).alias("account_type"),
        _log("relationship_years").alias("relationship_years_log"),
        _log("lifetime_tx_count").alias("lifetime_tx_log"),
        _num("lifetime_amount_log").alias("lifetime_amount_log"),
        _log("prior_sar_count").alias("prior_sar_count"),
        _log("prior_alert_count").alias("prior_alert_count"),
        _num("prior_confirmed_fraud").alias("prior_confirmed_fraud"),
        _log("monthly_avg_tx_count").alias("monthly_avg_tx_log"),
        _num("monthly_avg_amount_log").alias("monthly_avg_amount_log"),
        clip(_num("geographic_risk_score"), 0.0, 1.0).alias("geographic_risk_score"),
        _num("pep_flag").alias("pep_flag"),
        clip(F.coalesce(_num("industry_risk_score"), F.lit(0.0)), 0.0, 1.0).alias("industry_risk_score"),
        _log("distinct_devices_90d").alias("distinct_devices_log"),
        _log("avg_failed_auth_monthly").alias("avg_failed_auth_log"),
        (F.col("account_age_days") < 90).cast("double").alias("is_new_account"))


def device_vector(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "node_id",
        _log("first_seen_days_ago").alias("first_seen_log"),
        _log("associated_account_count").alias("assoc_accounts_log"),
        (F.col("platform") == 0).cast("double").alias("platform_android"),
        (F.col("platform") == 1).cast("double").alias("platform_ios"),
        clip(_num("device_risk_score"), 0.0, 1.0).alias("device_risk_score"),
        _num("has_root_jailbreak").alias("has_root_jailbreak"))


def ip_vector(nodes: DataFrame) -> DataFrame:
    composite = _num("is_tor") * 0.5 + _num("is_vpn") * 0.3 + _num("reputation_score") * 0.2
    return nodes.select(
        "node_id",
        clip(_num("reputation_score"), 0.0, 1.0).alias("reputation_score"),
        *[_num(c).alias(c) for c in ("is_tor", "is_vpn", "is_proxy")],
        clip(_num("country_risk_score"), 0.0, 1.0).alias("country_risk_score"),
        _log("associated_account_count").alias("assoc_accounts_log"),
        composite.alias("risk_composite"))


def merchant_vector(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "node_id",
        _log("merchant_age_days").alias("merchant_age_log"),
        clip(_num("mcc_risk_score"), 0.0, 1.0).alias("mcc_risk_score"),
        clip(_num("chargeback_rate_90d"), 0.0, 1.0).alias("chargeback_rate"),
        _log("dispute_count_90d").alias("dispute_count_log"),
        (F.col("merchant_age_days") < 30).cast("double").alias("is_new_merchant"),
        (F.col("chargeback_rate_90d") > 0.02).cast("double").alias("high_chargeback_flag"))


def _recency(hours: str) -> Column:
    return F.log1p(_num(hours) / 24)


def edge_vector(relation: str, edges: DataFrame) -> DataFrame:
    """src, dst and the numeric edge features of one relation."""
    features = {
        "TRANSACTS_WITH": lambda: [
            _log("transaction_count_30d").alias("tx_count_log"), _num("total_amount_30d_log").alias("amount_log"),
            _log("first_transaction_days_ago").alias("first_tx_recency"),
            _recency("last_transaction_hours_ago").alias("last_tx_recency"),
            _num("avg_amount_log").alias("avg_amount_log"), _num("is_recurring").alias("is_recurring"),
            clip(_num("edge_risk_score"), 0.0, 1.0).alias("edge_risk_score")],
        "USES_DEVICE": lambda: [
            _log("session_count_30d").alias("session_count_log"),
            _recency("last_session_hours_ago").alias("recency_log"),
            _num("is_primary_device").alias("is_primary_device")],
        "ORIGINATES_FROM": lambda: [
            _log("session_count_7d").alias("session_count_log"),
            _recency("last_session_hours_ago").alias("recency_log")],
        "TRANSACTS_AT": lambda: [
            _log("transaction_count_90d").alias("tx_count_log"), _num("total_amount_90d_log").alias("amount_log"),
            _num("is_first_transaction").alias("is_first_transaction")],
    }
    return edges.select("src_node_id", "dst_node_id", *features[relation]())


def typed_edges(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], store=lambda df, label: df) -> DataFrame:
    """One edge table over all relations, each followed by its reverse.

    `nodes` is keyed by node type, `edges` by `SRC__RELATION__DST`. An edge stays when both of
    its ends are nodes of the right type. `store` keeps each relation once, as `packed` ids; the
    reverse is read from the same rows.
    """
    parts = []
    for name, table in edges.items():
        pieces = name.split("__")
        if len(pieces) != 3:
            continue
        src_type, relation, dst_type = pieces
        sides = ["src_node_id", "dst_node_id"]
        ends = packed(table.select(*sides), *sides)
        for side, kind in zip(sides, (src_type, dst_type)):
            known = packed(nodes[kind].select(F.col("node_id").alias(side)), side)
            ends = spread_join(ends, known, [side], F.xxhash64(*sides), how="inner")
        ends = unpacked(store(ends, "typed-ends"), table, *sides)
        forward = ends.select(F.lit(relation).alias("relation"), F.lit(src_type).alias("src_type"),
                              F.lit(dst_type).alias("dst_type"), "src_node_id", "dst_node_id")
        back = ends.select(F.lit(f"REV_{relation}").alias("relation"), F.lit(dst_type).alias("src_type"),
                           F.lit(src_type).alias("dst_type"), F.col("dst_node_id").alias("src_node_id"),
                           F.col("src_node_id").alias("dst_node_id"))
        parts += [forward, back]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def project(vectors: dict[str, DataFrame], weights: dict[str, tuple]) -> DataFrame:
    """Bring every node type to one width: relu(W x + b) with a matrix per type."""
    parts = []
    for kind, table in vectors.items():
        matrix, bias = weights[kind]
        inputs = [c for c in table.columns if c != "node_id"]
        wide = dense(table, ["node_id"], inputs, matrix, bias, "h")
        parts.append(wide.select(F.lit(kind).alias("node_type"), "node_id",
                                 *[relu(F.col(c)).alias(c) for c in names("h", len(bias))]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relation_means(edges: DataFrame, vectors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of the senders' vectors per target and relation."""
    senders = vectors.select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src_node_id"), *columns)
    short = packed(edges, "src_node_id", "dst_node_id")
    sent = spread_join(short, packed(senders, "src_node_id"), ["src_type", "src_node_id"], F.xxhash64("dst_node_id"), how="inner")
    means = sent.groupBy(F.col("dst_type").alias("node_type"), F.col("dst_node_id").alias("node_id"), "relation").agg(
        *[F.avg(c).alias(c) for c in columns])
    return unpacked(means, vectors, "node_id")


def relation_mean(edges: DataFrame, vectors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The means added up over the relations of each target."""
    sums = packed(relation_means(edges, vectors, columns), "node_id").groupBy("node_type", "node_id").agg(
        *[F.sum(c).alias(c) for c in columns])
    return unpacked(sums, vectors, "node_id")


def typed_layer(edges: DataFrame, vectors: DataFrame, width: int, weights: dict[str, dict]) -> DataFrame:
    """Sum over relations of W_r mean_r + b_r + R_r x for each target, before normalisation.

    A target without messages of a relation still gets b_r + R_r x of every relation that ends
    in its type, so those parts are folded into one matrix per node type.
    """
    columns = names("h", width)
    means = relation_means(edges, vectors, columns)
    parts = []
    targets = {}
    for relation, (src, dst) in RELATIONS.items():
        targets.setdefault(dst, []).append(relation)
        targets.setdefault(src, []).append(f"REV_{relation}")
    for kind, relations in targets.items():
        root = np.sum([weights[r]["root"] for r in relations], axis=0)
        bias = np.sum([weights[r]["bias"] for r in relations], axis=0)
        parts.append(dense(vectors.where(F.col("node_type") == kind), ["node_type", "node_id"], columns, root, bias, "o"))
    for relation in weights:
        matrix = weights[relation]["neigh"]
        parts.append(dense(means.where(F.col("relation") == relation), ["node_type", "node_id"], columns,
                           matrix, [0.0] * len(matrix), "o"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    made = [c for c in out.columns if c.startswith("o")]
    sums = packed(out, "node_id").groupBy("node_type", "node_id").agg(*[F.sum(c).alias(f"h{i}") for i, c in enumerate(made)])
    return unpacked(sums, vectors, "node_id")


def batch_norm_relu(vectors: DataFrame, columns: Sequence[str], epsilon: float = 1e-5) -> DataFrame:
    """Scale each column to mean 0 and deviation 1 within its node type, then relu."""
    stats = vectors.groupBy("node_type").agg(
        *[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("m", F.avg), ("v", F.var_pop))])
    joined = vectors.join(F.broadcast(stats), "node_type")  # one row per node type, four types
    return joined.select("node_type", "node_id", *[
        F.greatest((F.col(c) - F.col(f"m_{c}")) / F.sqrt(F.col(f"v_{c}") + epsilon), F.lit(0.0)).alias(c)
        for c in columns])


def draw_order(seed: int, hop: int, src: str = "src_node_id", dst: str = "dst_node_id") -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(hop)), F.col(src), F.col(dst)))


def sample_neighbours(edges: DataFrame, seeds: DataFrame, fan_out: Sequence[int] = FAN_OUT,
                      seed: int = 42, store=materialize) -> DataFrame:
    """At most k senders per (target, relation) and hop, starting from the seed nodes.

    The draw is the order of a hash, so it is the same on every run and partitioning. The
    rank filter runs per map task before the shuffle: a hub sends at most k rows per task. Each hop
    is stored, as the next one starts from it; `edges` is a stored table.
    """
    ids = ["src_node_id", "dst_node_id"]
    short = packed(edges, *ids)
    busy = store(heavy_keys(short, ["dst_type", "dst_node_id"]), "busy")
    frontier = packed(seeds.select(F.col("node_type").alias("dst_type"), F.col("node_id").alias("dst_node_id")), "dst_node_id").distinct()
    hops = []
    for hop, k in enumerate(fan_out, start=1):
        reached = spread_join(short, frontier, ["dst_type", "dst_node_id"], F.xxhash64(*ids), how="inner", heavy=busy)
        order = Window.partitionBy("dst_type", "dst_node_id", "relation").orderBy("_draw", "src_node_id")
        # the draw goes by the texts, and so do ties
        drawn = (
            unpacked(reached, edges, *ids).withColumn("_draw", draw_order(seed, hop))
            .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
            .select(F.lit(hop).alias("hop"), "relation", "src_type", "dst_type", "src_node_id", "dst_node_id")
        )
        drawn = store(drawn, "hop")
        hops.append(drawn)
        frontier = packed(drawn.select(F.col("src_type").alias("dst_type"), F.col("src_node_id").alias("dst_node_id")), "dst_node_id").distinct()
    out = hops[0]
    for h in hops[1:]:
        out = out.unionByName(h)
    return out
