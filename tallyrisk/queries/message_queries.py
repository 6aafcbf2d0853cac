"""Message passing with fixed small weights, account scores, splits of accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import graph, positions, propagate, short_ids
from ..session import discard, materialize
from .base import NUDGE, query, round_sql, rounded, tidy, tx
from .graph_queries import _ACCOUNT_NAMES, _ACCOUNT_SQL, account_tx, derived_sql, graph_tx, with_graph

_NAMES = sorted({*_ACCOUNT_NAMES, "device_fingerprint_hash", "merchant_category_code"})

FEATS = schema.ACCOUNT_FEATURES
HIDDEN = 3


def weight(i: int, j: int, salt: int) -> float:
    return ((i * 7 + j * 3 + salt) % 11 - 5) / 20


def matrix(rows: int, columns: int, salt: int) -> list[list[float]]:
    return [[weight(i, j, salt) for j in range(columns)] for i in range(rows)]


def vector(rows: int, salt: int) -> list[float]:
    return [weight(i, 1, salt) for i in range(rows)]


def layer(inputs: int, salt: int) -> dict:
    return {"w_self": matrix(HIDDEN, inputs, salt), "b_self": vector(HIDDEN, salt + 1),
            "w_neigh": matrix(HIDDEN, inputs, salt + 2), "b_neigh": vector(HIDDEN, salt + 3)}


MODEL = {"layer1": layer(len(FEATS), 1), "layer2": layer(HIDDEN, 5),
         "head": {"w": matrix(2, HIDDEN, 9), "b": vector(2, 10)},
         "out": {"w": matrix(2, 2, 3), "b": vector(2, 4)}}


def parts(spark, sf_dir):
    """Nodes and messages, stored between the stages because later steps read them repeatedly; and a
    function that brings back the ids, which are numbers in both."""
    df = graph_tx(spark, sf_dir).select(*_NAMES, "ip_node_id", "merchant_node_id")
    df = materialize(df, "transactions")
    ids = materialize(short_ids.distinct_ids(df, "account_id_hash", "beneficiary_id_hash"), "ids")
    seed = short_ids.hash_seed(ids)
    nodes = materialize(short_ids.shortened(graph.account_nodes(df), seed, "node_id"), "nodes")
    derived = graph.shared_entity_edges(graph.device_edges(df), graph.ip_edges(df), graph.merchant_edges(df))
    ends = ["src_node_id", "dst_node_id"]
    transfers = materialize(short_ids.shortened(graph.transfer_edges(df).select(*ends), seed, *ends), "transfers")
    derived = materialize(short_ids.shortened(derived.select(*ends), seed, *ends), "derived")
    discard(df)
    messages = materialize(propagate.message_edges(nodes, transfers, derived), "messages")
    discard(transfers, derived)
    return nodes, messages, lambda out, *names: short_ids.restored(out, ids, seed, *names)


def scaled(spark, sf_dir):
    nodes, edges, restore = parts(spark, sf_dir)
    return propagate.standardize(nodes, propagate.feature_statistics(nodes)), edges, restore


# ---- the same in SQL --------------------------------------------------------------------

_NODES = _ACCOUNT_SQL.lstrip(", \n")
_HEAD, _BODY = _NODES.rsplit("\nselect node_id, age", 1)
NODE_CTE = f", {_HEAD}, nodes as (\nselect node_id, age{_BODY}\n)"
EDGE_CTE = f""", pairs as (
  select account_id_hash as s, beneficiary_id_hash as d from (select distinct account_id_hash, beneficiary_id_hash from g) as x
  union all select src_node_id, dst_node_id from ({derived_sql()}) as y
), edges as (
  select s, d from pairs union all select d, s from pairs union all select node_id, node_id from nodes
)"""
SCALED_CTE = ", st as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as d_{c}" for c in FEATS) \
    + " from nodes), x as (select node_id, " \
    + ", ".join(f"({c} - m_{c}) / (case when d_{c} = 0 then 1e0 else d_{c} end) as {c}" for c in FEATS) \
    + " from nodes, st)"


def mean_cte(name: str, source: str, columns: list[str]) -> str:
    return (f", {name} as (select d as node_id, " + ", ".join(f"avg({c}) as n_{c}" for c in columns)
            + f" from edges join {source} on s = node_id group by 1)")


def linear_sql(inputs: list[str], row: list[float], bias: float) -> str:
    return " + ".join([f"({bias!r}e0)"] + [f"({w!r}e0) * {c}" for c, w in zip(inputs, row)])


def layer_cte(name: str, source: str, mean: str, columns: list[str], lay: dict, prefix: str) -> str:
    outs = []
    for i in range(len(lay["b_self"])):
        own = linear_sql([f"a.{c}" for c in columns], lay["w_self"][i], lay["b_self"][i])
        near = linear_sql([f"b.n_{c}" for c in columns], lay["w_neigh"][i], lay["b_neigh"][i])
        outs.append(f"greatest({own} + {near}, 0e0) as {prefix}{i}")
    return f", {name} as (select a.node_id, {', '.join(outs)} from {source} a join {mean} b on a.node_id = b.node_id)"


HID = [f"h{i}" for i in range(HIDDEN)]
EMB = [f"e{i}" for i in range(HIDDEN)]
L1 = mean_cte("m1", "x", FEATS) + layer_cte("l1", "x", "m1", FEATS, MODEL["layer1"], "h")
L2 = mean_cte("m2", "l1", HID) + layer_cte("l2", "l1", "m2", HID, MODEL["layer2"], "e")
PROB = (", mid as (select node_id, " + ", ".join(
    f"greatest({linear_sql(EMB, MODEL['head']['w'][i], MODEL['head']['b'][i])}, 0e0) as m{i}" for i in range(2))
    + " from l2), pr as (select node_id, 1e0 / (1e0 + exp((" + linear_sql(["m0", "m1"], MODEL["out"]["w"][0], MODEL["out"]["b"][0])
    + ") - (" + linear_sql(["m0", "m1"], MODEL["out"]["w"][1], MODEL["out"]["b"][1]) + "))) as p from mid)")


def full(sql: str, *ctes: str) -> str:
    return with_graph("", _NAMES).rstrip() + "".join(ctes) + "\n" + sql


@query("graph_message_edges", full(
    "select s as src_node_id, d as dst_node_id, count(*) as copies from edges group by 1, 2", NODE_CTE, EDGE_CTE))
def _edges(spark, sf_dir):
    _, edges, restore = parts(spark, sf_dir)
    counted = edges.groupBy("src_node_id", "dst_node_id").agg(F.count(F.lit(1)).alias("copies"))
    return restore(counted, "src_node_id", "dst_node_id").select("src_node_id", "dst_node_id", "copies")


@query("graph_scaled_features", rounded(full("select * from x", NODE_CTE, SCALED_CTE), *FEATS))
def _scaled(spark, sf_dir):
    nodes = graph.account_nodes(account_tx(spark, sf_dir))
    return tidy(propagate.standardize(nodes, propagate.feature_statistics(nodes)))


@query("graph_neighbour_mean", rounded(full(
    "select node_id, " + ", ".join(f"n_{c}" for c in FEATS) + " from m1", NODE_CTE, EDGE_CTE, SCALED_CTE,
    mean_cte("m1", "x", FEATS)), *[f"n_{c}" for c in FEATS]))
def _mean(spark, sf_dir):
    vectors, edges, restore = scaled(spark, sf_dir)
    out = propagate.neighbour_mean(edges, vectors, FEATS)
    return tidy(restore(out, "node_id").select("node_id", *[f"n_{c}" for c in FEATS]))


@query("graph_sage_layer", rounded(full("select * from l1", NODE_CTE, EDGE_CTE, SCALED_CTE, L1), *HID))
def _layer(spark, sf_dir):
    vectors, edges, restore = scaled(spark, sf_dir)
    out = propagate.sage_layer(vectors, FEATS, edges, MODEL["layer1"], "h")
    return tidy(restore(out, "node_id").select("node_id", *HID))


@query("graph_embeddings", rounded(full("select * from l2", NODE_CTE, EDGE_CTE, SCALED_CTE, L1, L2), *EMB))
def _embeddings(spark, sf_dir):
    vectors, edges, restore = scaled(spark, sf_dir)
    out = propagate.embeddings(vectors, FEATS, edges, MODEL)
    return tidy(restore(out, "node_id").select("node_id", *EMB))


def probabilities(spark, sf_dir):
    vectors, edges, restore = scaled(spark, sf_dir)
    found = propagate.account_probability(propagate.embeddings(vectors, FEATS, edges, MODEL), MODEL)
    return restore(found, "node_id").select("node_id", "probability")


_ALL = (NODE_CTE, EDGE_CTE, SCALED_CTE, L1, L2, PROB)


@query("graph_account_scores", full(
    f"select node_id as account_id_hash, {round_sql('p')} as gnn_fraud_probability, "
    "cast(round_even(p * 100, 0) as bigint) as gnn_risk_score from pr", *_ALL))
def account_scores(spark, sf_dir):
    return tidy(propagate.score_table(probabilities(spark, sf_dir)))


@query("graph_score_summary", full(
    f'select count(*) as "rows", {round_sql("avg(p)")} as mean_gnn_fraud_probability, '
    f"{round_sql('max(p)')} as max_gnn_fraud_probability from pr", *_ALL))
def _summary(spark, sf_dir):
    return tidy(propagate.score_summary(propagate.score_table(probabilities(spark, sf_dir))))


@query("graph_score_sink_rows", full(
    "select concat('gnn:score:', node_id) as \"key\", "
    f"{round_sql('p', 5)} as value, 1704067200000000 + 7200000000 as expires_at from pr", *_ALL))
def _sink(spark, sf_dir):
    scores = materialize(propagate.score_table(probabilities(spark, sf_dir)), "scores")
    out = propagate.expiring_scores(scores, F.timestamp_seconds(F.lit(1704067200)))
    # the stored text has six digits; one fewer is compared so that float noise cannot show
    p = scores.select("account_id_hash", F.round(F.col("gnn_fraud_probability") + NUDGE, 5).alias("p"))
    joined = out.join(p, out.key == F.concat(F.lit("gnn:score:"), p.account_id_hash))
    agrees = F.abs(F.col("value").cast("double") - F.col("p")) <= 5.6e-6
    return tidy(joined.select("key", F.when(agrees, F.col("p")).alias("value"), "expires_at"))


@query("split_class_weights", full(
    "select label, total / greatest(n, 1) / (select avg(total / greatest(n, 1)) from c) as weight from c",
    NODE_CTE, ", n as (select count(*) as total, sum(node_label) as ones from nodes), "
              "c as (select 0::bigint as label, total - ones as n, total::double as total from n union all select 1, ones, total from n)")
       .replace("select label, total / greatest(n, 1) / (select avg(total / greatest(n, 1)) from c) as weight",
                f"select label, {round_sql('total / greatest(n, 1) / (select avg(total / greatest(n, 1)) from c)')} as weight"))
def _class_weights(spark, sf_dir):
    return tidy(propagate.class_weights(graph.account_nodes(account_tx(spark, sf_dir))))


_ACC = ", o as (select node_id, last_tx, row_number() over (order by last_tx, node_id) - 1 as i, count(*) over () as n from nodes)"


@query("split_accounts_temporal", full(
    "select node_id, case when i < floor(n * 0.8e0) then 'train' when i < floor(n * 0.9e0) then 'val' else 'test' end as split from o",
    NODE_CTE, _ACC))
def _acc_split(spark, sf_dir):
    nodes = materialize(graph.account_nodes(tx(spark, sf_dir)).select("node_id", "last_tx"), "nodes")  # read by each pass
    return positions.account_temporal_split(nodes).select("node_id", "split")


@query("split_accounts_cutoff", full(
    "select node_id, case when last_tx <= (select last_tx from o where i = floor(n * 0.8e0)) then 'train' "
    "when last_tx <= (select last_tx from o where i = floor(n * 0.9e0)) then 'val' else 'test' end as split from o",
    NODE_CTE, _ACC))
def _acc_cutoff(spark, sf_dir):
    nodes = materialize(graph.account_nodes(tx(spark, sf_dir)).select("node_id", "last_tx"), "nodes")  # read by each pass
    return positions.cutoff_split(nodes).select("node_id", "split")
