"""Typed node and edge features, typed edges, relation means, neighbour sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, typed_graph
from ..operators.short_ids import packed, unpacked
from ..session import discard, materialize
from .base import ORACLES, log1p, query, rounded, tidy, tx
from .graph_queries import graph_tx, with_graph
from .message_queries import NODE_CTE, _NAMES, full, vector, matrix


def _account_sql():
    return f"""select node_id, {log1p('account_age_days')} as account_age_log, kyc_tier / 3e0 as kyc_tier, account_type / 2e0 as account_type,
 {log1p('relationship_years')} as relationship_years_log, {log1p('lifetime_tx_count')} as lifetime_tx_log, lifetime_amount_log,
 {log1p('prior_sar_count')} as prior_sar_count, {log1p('prior_alert_count')} as prior_alert_count,
 prior_confirmed_fraud::double as prior_confirmed_fraud, {log1p('monthly_avg_tx_count')} as monthly_avg_tx_log, monthly_avg_amount_log,
 geographic_risk_score, pep_flag::double as pep_flag, industry_risk_score, {log1p('distinct_devices_90d')} as distinct_devices_log,
 {log1p('avg_failed_auth_monthly')} as avg_failed_auth_log, (account_age_days < 90)::int::double as is_new_account from nodes"""


_ACC = ["account_age_log", "kyc_tier", "account_type", "relationship_years_log", "lifetime_tx_log", "lifetime_amount_log",
        "prior_sar_count", "prior_alert_count", "prior_confirmed_fraud", "monthly_avg_tx_log", "monthly_avg_amount_log",
        "geographic_risk_score", "pep_flag", "industry_risk_score", "distinct_devices_log", "avg_failed_auth_log",
        "is_new_account"]


@query("typed_account_features", rounded(full(_account_sql(), NODE_CTE), *_ACC))
def _accounts(spark, sf_dir):
    return tidy(typed_graph.account_vector(graph.account_nodes(tx(spark, sf_dir))))


_DEV = (f"select device_fingerprint_hash as node_id, {log1p('floor(greatest((epoch_us((select max(transaction_dt) from g)) - epoch_us(min(transaction_dt))) / 1e6 / 86400, 0))')} as first_seen_log, "
        f"{log1p('count(distinct account_id_hash)')} as assoc_accounts_log, "
        "(cast(concat('0x', substring(sha256(device_fingerprint_hash), 1, 8)) as bigint) % 4 = 0)::int::double as platform_android, "
        "(cast(concat('0x', substring(sha256(device_fingerprint_hash), 1, 8)) as bigint) % 4 = 1)::int::double as platform_ios, "
        "avg(behavioural_drift_score) as device_risk_score, max(is_tor_vpn_proxy::int)::double as has_root_jailbreak "
        "from g where device_fingerprint_hash is not null group by 1")
_DEVN = ["device_fingerprint_hash", "transaction_dt", "behavioural_drift_score", "is_tor_vpn_proxy"]


@query("typed_device_features", rounded(with_graph(_DEV, _DEVN), "first_seen_log", "assoc_accounts_log", "device_risk_score"))
def _devices(spark, sf_dir):
    return tidy(typed_graph.device_vector(graph.device_nodes(tx(spark, sf_dir))))


_IP = (f"select ip_node_id as node_id, avg(ip_reputation_score) as reputation_score, max(is_tor_vpn_proxy::int)::double as is_tor, "
       "max(is_tor_vpn_proxy::int)::double as is_vpn, max(is_tor_vpn_proxy::int)::double as is_proxy, "
       f"avg(geo_country_mismatch::int) as country_risk_score, {log1p('count(distinct account_id_hash)')} as assoc_accounts_log, "
       "max(is_tor_vpn_proxy::int) * 0.5e0 + max(is_tor_vpn_proxy::int) * 0.3e0 + avg(ip_reputation_score) * 0.2e0 as risk_composite "
       "from g group by 1")


@query("typed_ip_features", rounded(with_graph(_IP, ["ip_reputation_score", "is_tor_vpn_proxy", "geo_country_mismatch"]),
       "reputation_score", "country_risk_score", "assoc_accounts_log", "risk_composite"))
def _ips(spark, sf_dir):
    return tidy(typed_graph.ip_vector(graph.ip_nodes(graph_tx(spark, sf_dir))))


_AGE = "30 + cast(concat('0x', substring(sha256(merchant_node_id), 1, 8)) as bigint) % 3650"
_MER = (f"select merchant_node_id as node_id, {log1p(_AGE)} as merchant_age_log, "
        "(select avg(label_is_fraud) from g g2 where g2.merchant_node_id = g.merchant_node_id) as mcc_risk_score, "
        f"avg(label_is_fraud) as chargeback_rate, {log1p('least(sum(second_hop_sar_count), 32767)')} as dispute_count_log, "
        f"({_AGE} < 30)::int::double as is_new_merchant, (avg(label_is_fraud) > 0.02)::int::double as high_chargeback_flag "
        "from g where merchant_category_code is not null group by merchant_node_id")


@query("typed_merchant_features", rounded(with_graph(_MER, ["label_is_fraud", "second_hop_sar_count"]),
       "merchant_age_log", "mcc_risk_score", "chargeback_rate", "dispute_count_log"))
def _merchants(spark, sf_dir):
    return tidy(typed_graph.merchant_vector(graph.merchant_nodes(graph_tx(spark, sf_dir))))


def _unrounded(name):
    """The registered SQL of an edge table, before its doubles were rounded."""
    inner = ORACLES[name].split("from (\n", 1)[1].rsplit("\n) as q", 1)[0]
    return inner


def _edge_features(relation, table, sql, doubles):
    @query(f"typed_edges_{relation.lower()}", rounded(f"with e as (\n{_unrounded(table)}\n)\n{sql}", *doubles))
    def run(spark, sf_dir):
        builder = {"edge_transfers": graph.transfer_edges, "edge_devices": graph.device_edges,
                   "edge_ips": graph.ip_edges, "edge_merchants": graph.merchant_edges}[table]
        return tidy(typed_graph.edge_vector(relation, builder(graph_tx(spark, sf_dir))))


_edge_features("TRANSACTS_WITH", "edge_transfers",
               f"select src_node_id, dst_node_id, {log1p('transaction_count_30d')} as tx_count_log, total_amount_30d_log as amount_log, "
               f"{log1p('first_transaction_days_ago')} as first_tx_recency, {log1p('last_transaction_hours_ago / 24')} as last_tx_recency, "
               "avg_amount_log, is_recurring::double as is_recurring, edge_risk_score from e",
               ["tx_count_log", "amount_log", "first_tx_recency", "last_tx_recency", "avg_amount_log", "edge_risk_score"])
_edge_features("USES_DEVICE", "edge_devices",
               f"select src_node_id, dst_node_id, {log1p('session_count_30d')} as session_count_log, "
               f"{log1p('last_session_hours_ago / 24')} as recency_log, is_primary_device::double as is_primary_device from e",
               ["session_count_log", "recency_log"])
_edge_features("ORIGINATES_FROM", "edge_ips",
               f"select src_node_id, dst_node_id, {log1p('session_count_7d')} as session_count_log, "
               f"{log1p('last_session_hours_ago / 24')} as recency_log from e", ["session_count_log", "recency_log"])
_edge_features("TRANSACTS_AT", "edge_merchants",
               f"select src_node_id, dst_node_id, {log1p('transaction_count_90d')} as tx_count_log, total_amount_90d_log as amount_log, "
               "is_first_transaction::double as is_first_transaction from e", ["tx_count_log", "amount_log"])


def typed_parts(spark, sf_dir):
    df = materialize(graph_tx(spark, sf_dir).select(*_TYPED_NAMES, "ip_node_id", "merchant_node_id"), "transactions")
    nodes = {"account": graph.account_nodes(df), "device": graph.device_nodes(df),
             "ip": graph.ip_nodes(df), "merchant": graph.merchant_nodes(df)}
    nodes = {k: unpacked(materialize(packed(v, "node_id"), f"{k}-nodes"), v, "node_id") for k, v in nodes.items()}
    makers = {
        "account__TRANSACTS_WITH__account": graph.transfer_edges,
        "account__USES_DEVICE__device": graph.device_edges,
        "account__ORIGINATES_FROM__ip": graph.ip_edges,
        "account__TRANSACTS_AT__merchant": graph.merchant_edges,
    }
    edges, stored, ends = {}, [], ["src_node_id", "dst_node_id"]
    for name, make in makers.items():
        table = make(df).select(*ends)
        stored.append(materialize(packed(table, *ends), "ends"))
        edges[name] = unpacked(stored[-1], table, *ends)
    discard(df)
    out = typed_graph.typed_edges(nodes, edges, store=materialize)
    discard(*stored)
    return nodes, out


_TYPED_NAMES = sorted({*_NAMES, "behavioural_drift_score", "is_tor_vpn_proxy", "geo_country_mismatch"})


def _typed_edge_cte():
    rel = [("TRANSACTS_WITH", "account", "beneficiary_id_hash"), ("USES_DEVICE", "device", "device_fingerprint_hash"),
           ("ORIGINATES_FROM", "ip", "ip_node_id"), ("TRANSACTS_AT", "merchant", "merchant_node_id")]
    out = []
    for name, kind, key in rel:
        # a category of NULL has edges but no node
        where = "merchant_category_code is not null" if kind == "merchant" else f"{key} is not null"
        base = f"(select distinct account_id_hash as a, {key} as b from g where {where})"
        out.append(f"select '{name}' as relation, 'account' as src_type, '{kind}' as dst_type, a as src_node_id, b as dst_node_id from {base} as f")
        out.append(f"select 'REV_{name}', '{kind}', 'account', b, a from {base} as f")
    return ", te as materialized (" + " union all ".join(out) + ")"


def _typed(sql, *ctes):
    return with_graph("", _TYPED_NAMES).rstrip() + _typed_edge_cte() + "".join(ctes) + "\n" + sql


@query("typed_edge_table", _typed("select * from te"))
def _table(spark, sf_dir):
    return typed_parts(spark, sf_dir)[1]


WIDTH = 2
_INPUTS = {"account": _ACC, "device": ["first_seen_log", "assoc_accounts_log", "platform_android", "platform_ios",
                                      "device_risk_score", "has_root_jailbreak"],
           "ip": ["reputation_score", "is_tor", "is_vpn", "is_proxy", "country_risk_score", "assoc_accounts_log", "risk_composite"],
           "merchant": ["merchant_age_log", "mcc_risk_score", "chargeback_rate", "dispute_count_log", "is_new_merchant",
                        "high_chargeback_flag"]}
PROJECTION = {k: (matrix(WIDTH, len(v), i + 2), vector(WIDTH, i)) for i, (k, v) in enumerate(_INPUTS.items())}


def projected(nodes):
    make = {"account": typed_graph.account_vector, "device": typed_graph.device_vector,
            "ip": typed_graph.ip_vector, "merchant": typed_graph.merchant_vector}
    vectors = {k: make[k](v).na.fill(0.0) for k, v in nodes.items()}
    return typed_graph.project(vectors, PROJECTION)


def _projection_cte():
    source = {"account": f"({_account_sql()})", "device": f"({_DEV})", "ip": f"({_IP})", "merchant": f"({_MER})"}
    parts = []
    for kind, inputs in _INPUTS.items():
        outs = []
        for i in range(WIDTH):
            m, b = PROJECTION[kind][0][i], PROJECTION[kind][1][i]
            outs.append("greatest(" + " + ".join([f"({b!r}e0)"] + [f"({w!r}e0) * coalesce({c}, 0)" for c, w in zip(inputs, m)]) + f", 0e0) as h{i}")
        parts.append(f"select '{kind}' as node_type, node_id, {', '.join(outs)} from {source[kind]} as v{kind}")
    return NODE_CTE + ", pj as materialized (" + " union all ".join(parts) + ")"


_H = [f"h{i}" for i in range(WIDTH)]
_MEAN = (", rm as (select dst_type as node_type, dst_node_id as node_id, relation, " + ", ".join(f"avg({h}) as {h}" for h in _H)
         + " from te join pj on src_type = node_type and src_node_id = node_id group by 1, 2, 3)")


@query("typed_projection", rounded(_typed("select * from pj", _projection_cte()), *_H))
def _project(spark, sf_dir):
    return tidy(projected(typed_parts(spark, sf_dir)[0]))


@query("typed_relation_mean", rounded(_typed(
    "select node_type, node_id, " + ", ".join(f"sum({h}) as {h}" for h in _H) + " from rm group by 1, 2", _projection_cte(), _MEAN), *_H))
def _relation_mean(spark, sf_dir):
    nodes, edges = typed_parts(spark, sf_dir)
    return tidy(typed_graph.relation_mean(edges, materialize(projected(nodes), "vectors"), _H))


RELATION_WEIGHTS = {r: {"neigh": matrix(WIDTH, WIDTH, i + 1), "root": matrix(WIDTH, WIDTH, i + 4), "bias": vector(WIDTH, i)}
                    for i, r in enumerate([p + r for r in typed_graph.RELATIONS for p in ("", "REV_")])}


def _layer_sql():
    ends = {}
    for relation, (src, dst) in typed_graph.RELATIONS.items():
        ends[relation], ends[f"REV_{relation}"] = dst, src
    parts = []
    for r, w in RELATION_WEIGHTS.items():
        root = [" + ".join([f"({w['bias'][i]!r}e0)"] + [f"({w['root'][i][j]!r}e0) * h{j}" for j in range(WIDTH)]) + f" as h{i}" for i in range(WIDTH)]
        near = [" + ".join(f"({w['neigh'][i][j]!r}e0) * h{j}" for j in range(WIDTH)) + f" as h{i}" for i in range(WIDTH)]
        parts.append(f"select node_type, node_id, {', '.join(root)} from pj where node_type = '{ends[r]}'")
        parts.append(f"select node_type, node_id, {', '.join(near)} from rm where relation = '{r}'")
    return "select node_type, node_id, " + ", ".join(f"sum({h}) as {h}" for h in _H) + " from (" + " union all ".join(parts) + ") as p group by 1, 2"


_NORM = (", ly as materialized (" + _layer_sql() + "), sx as (select node_type as t, " + ", ".join(f"avg({h}) as m_{h}, var_pop({h}) as v_{h}" for h in _H)
         + " from ly group by 1)")


@query("typed_layer", rounded(_typed("select node_type, node_id, " + ", ".join(
    f"greatest(({h} - m_{h}) / sqrt(v_{h} + 1e-5), 0e0) as {h}" for h in _H) + " from ly join sx on node_type = t",
    _projection_cte(), _MEAN, _NORM), *_H))
def _layer(spark, sf_dir):
    nodes, edges = typed_parts(spark, sf_dir)
    vectors = materialize(projected(nodes), "vectors")
    out = materialize(typed_graph.typed_layer(edges, vectors, WIDTH, RELATION_WEIGHTS), "layer")
    return tidy(typed_graph.batch_norm_relu(out, _H))


def _hop(n, frontier, k):
    return (f", s{n} as materialized (select {n} as hop, relation, src_type, dst_type, src_node_id, dst_node_id from (select te.*, row_number() over "
            f"(partition by dst_type, dst_node_id, relation order by md5(concat_ws('|', '42', '{n}', src_node_id, dst_node_id)), src_node_id) as rn "
            f"from te join (select distinct t, i from ({frontier}) as q) as fr on dst_type = t and dst_node_id = i) as z where rn <= {k})")


_SEEDS = "select 'account' as t, account_id_hash as i from g where watchlist_hit"


@query("typed_neighbour_sample", _typed(
    "select hop::bigint as hop, relation, src_type, dst_type, src_node_id, dst_node_id from (select * from s1 union all select * from s2 union all select * from s3) as u",
    _hop(1, _SEEDS, 15), _hop(2, "select src_type as t, src_node_id as i from s1", 10),
    _hop(3, "select src_type as t, src_node_id as i from s2", 5)))
def _sample(spark, sf_dir):
    _, edges = typed_parts(spark, sf_dir)
    seeds = tx(spark, sf_dir).where("watchlist_hit").select(
        F.lit("account").alias("node_type"), F.col("account_id_hash").alias("node_id"))
    return tidy(typed_graph.sample_neighbours(edges, materialize(seeds.distinct(), "seeds")))
