"""Behavioural columns over the transaction view and the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract, features, graph
from ..operators.short_ids import distinct_ids, hash_seed, restored, shortened
from ..session import materialize
from ..sources import sample_view
from .quality_queries import _bad as bad_rows, defective
from .base import query, round_sql, rounded, tidy, tx, with_tx
from .feature_queries import feature_sql
from .graph_queries import graph_tx, with_graph

A, T, B = "account_id_hash", "transaction_dt", "beneficiary_id_hash"


def _win(interval, key=A, ts=T):
    return f"over (partition by {key} order by {ts} range between interval '{interval}' preceding and current row)"


_V = (["1 hour", "6 hours", "24 hours", "7 days"], ["1h", "6h", "24h", "7d"])
_P = "cast(round(amount_inr * 100) as hugeint)"
VELOCITY_SQL = ", ".join(
    [f"count(*) {_win(i)} as velocity_{n}" for i, n in zip(*_V)]
    + [f"(sum({_P}) {_win(i)})::double / 100 as amount_sum_{n}" for i, n in (("1 hour", "1h"), ("24 hours", "24h"))]
    + [f"(sum({_P}) {_win('90 days')})::double / (count(*) {_win('90 days')}) / 100 as amount_mean_90d",
       f"sqrt(((count(*) {_win('90 days')}) * (sum({_P} * {_P}) {_win('90 days')}) - (sum({_P}) {_win('90 days')}) * (sum({_P}) {_win('90 days')}))::double"
       f" / nullif((count(*) {_win('90 days')}) * ((count(*) {_win('90 days')}) - 1), 0)) / 100 as amount_std_90d",
       f"(count(*) {_win('90 days')}) / 90e0 as typical_velocity_daily"])
_VD = ["amount_sum_1h", "amount_sum_24h", "amount_mean_90d", "amount_std_90d", "typical_velocity_daily"]
_TIME = f"epoch_us({T}) as {T}"


@query("contract_velocities", rounded(with_tx(
    f"select distinct * replace ({_TIME}) from (select {A}, {T}, {VELOCITY_SQL} from tx) as q", A, T, "amount_inr"), *_VD))
def _velocities(spark, sf_dir):
    return tidy(contract.velocities(tx(spark, sf_dir)))


@query("contract_distinct_beneficiaries", with_tx(
    f"select distinct {A}, {_TIME}, n6 as distinct_beneficiaries_6h, n24 as distinct_beneficiaries_24h from (select {A}, {T}, "
    f"count(distinct {B}) {_win('6 hours')} as n6, count(distinct {B}) {_win('24 hours')} as n24 from tx) as q", A, T, B))
def _distinct(spark, sf_dir):
    return tidy(contract.distinct_beneficiaries(tx(spark, sf_dir)))


@query("contract_distinct_devices", with_tx(
    f"select distinct {A}, {_TIME}, n as distinct_devices_30d from (select {A}, {T}, "
    f"count(distinct device_fingerprint_hash) {_win('30 days')} as n from tx) as q", A, T, "device_fingerprint_hash"))
def _devices(spark, sf_dir):
    return tidy(contract.distinct_devices(tx(spark, sf_dir)))


def events(spark, sf_dir):
    return sample_view.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("contract_failed_auth", "select distinct user_id, epoch_us(ts) as ts, n::bigint as failed_auth_count_7d from ("
       f"select user_id, ts, sum((event_type = 'error')::int) {_win('7 days', 'user_id', 'ts')} as n from events) as q")
def _failed(spark, sf_dir):
    return tidy(contract.failed_authentications(events(spark, sf_dir), "user_id", "ts", F.col("event_type") == "error"))


@query("contract_event_velocities", "select distinct user_id, epoch_us(ts) as ts, n1 as n_1h, n24 as n_24h, "
       "d24::bigint as kinds_24h from (select user_id, ts, "
       f"count(*) {_win('1 hour', 'user_id', 'ts')} as n1, count(*) {_win('24 hours', 'user_id', 'ts')} as n24, "
       f"count(distinct event_type) {_win('24 hours', 'user_id', 'ts')} as d24 from events) as q")
def _event_velocity(spark, sf_dir):
    ev = events(spark, sf_dir)
    sums = contract.rolling_sums(ev, "user_id", "ts", {"n": F.lit(1).cast("bigint")},
                                 {"1h": contract.HOUR, "24h": contract.DAY})
    kinds = contract.rolling_distinct(ev, "user_id", "event_type", "ts", contract.DAY, "kinds_24h")
    return tidy(sums.join(kinds, ["user_id", "ts"]))


@query("contract_new_beneficiary", with_tx(
    f"select transaction_id, row_number() over (partition by {A}, {B} order by {T}, transaction_id) = 1 as is_new_beneficiary from tx",
    "transaction_id", A, B, T))
def _new(spark, sf_dir):
    return contract.new_beneficiary(tx(spark, sf_dir)).select("transaction_id", "is_new_beneficiary")


@query("contract_dormant_account", with_tx(
    f"select transaction_id, coalesce(epoch_us({T}) - epoch_us(lag({T}) over (partition by {A} order by {T}, transaction_id)) > 90 * 86400000000, false) "
    "as is_dormant_account from tx", "transaction_id", A, T))
def _dormant(spark, sf_dir):
    return contract.dormant_account(tx(spark, sf_dir)).select("transaction_id", "is_dormant_account")


@query("contract_new_beneficiary_defective", bad_rows(
    f"select transaction_id, {A}, {B}, epoch_us({T}) as at, {A} is not null and {B} is not null and {T} is not null and dense_rank() over "
    f"(partition by {A}, {B} order by {T}, transaction_id) = 1 as is_new_beneficiary from bad"))
def _new_defective(spark, sf_dir):
    """Rows without an id and with a repeated one: each is judged by itself, and none is lost or doubled."""
    rows = contract.new_beneficiary(materialize(defective(spark, sf_dir).select("transaction_id", A, B, T), "transactions"))
    return rows.select("transaction_id", A, B, F.unix_micros(T).alias("at"), "is_new_beneficiary")


@query("contract_dormant_account_defective", bad_rows(
    f"select transaction_id, {A}, instant, coalesce({A} is not null and first_row = 1 and instant - earlier > 90 * 86400000000, false) as is_dormant_account from ("
    f"select transaction_id, {A}, epoch_us({T}) as instant, dense_rank() over (partition by {A}, {T} order by transaction_id) as first_row, "
    f"max(epoch_us({T})) over (partition by {A} order by epoch_us({T}) range between unbounded preceding and 1 preceding) as earlier from bad) as q"))
def _dormant_defective(spark, sf_dir):
    rows = contract.dormant_account(materialize(defective(spark, sf_dir).select("transaction_id", A, T), "transactions"))
    return rows.select("transaction_id", A, F.unix_micros(T).alias("instant"), "is_dormant_account")


_PLACE = "((hash8 % 1200) / 10e0 - 60)", "((hash8 // 1200 % 3400) / 10e0 - 170)"


@query("contract_login_distance", with_tx(f""", h as (select *, cast(concat('0x', substring(sha256(transaction_id), 1, 8)) as bigint) as hash8 from tx
), pl as (select {A}, {T}, max(({_PLACE[0]}, {_PLACE[1]})) as p from h group by 1, 2
), lg as (select {A}, {T}, p[1] as lat, p[2] as lon, lag(p[1]) over w as la, lag(p[2]) over w as lo from pl window w as (partition by {A} order by {T}))
select {A}, {_TIME}, {round_sql("2 * 6371e0 * asin(sqrt(least(1e0, sin(radians(lat - la) / 2) ** 2 + cos(radians(la)) * cos(radians(lat)) * sin(radians(lon - lo) / 2) ** 2)))", 3)} as geo_distance_km from lg""",
    "transaction_id", A, T))
def _distance(spark, sf_dir):
    places = tx(spark, sf_dir).withColumn("hash8", F.conv(F.substring(F.sha2("transaction_id", 256), 1, 8), 16, 10).cast("bigint"))
    places = places.selectExpr(A, T, "(hash8 % 1200) / 10e0 - 60 as lat", "(hash8 div 1200 % 3400) / 10e0 - 170 as lon")
    return tidy(contract.login_distance(places, A, T, "lat", "lon"), 3)


def _drift_sql():
    b = "least(floor(log2(greatest(amount_inr, 1e0)) / 4), 7)"
    counts = ", ".join(f"sum((b = {i})::int) {_win(w)} as {s}{i}" for i in range(8) for w, s in (("7 days", "r"), ("90 days", "g")))
    rt, gt = (" + ".join(f"{s}{i}" for i in range(8)) for s in ("r", "g"))
    kl = " + ".join(f"((r{i} + 1) / ({rt} + 8)::double) * ln(((r{i} + 1) / ({rt} + 8)::double) / ((g{i} + 1) / ({gt} + 8)::double))" for i in range(8))
    return (f"select distinct {A}, {_TIME}, {round_sql(f'1 - exp(-({kl}))')} as behavioural_drift_score from ("
            f"select {A}, {T}, {counts} from (select *, {b} as b from tx) as z) as q")


@query("contract_behavioural_drift", with_tx(_drift_sql(), A, T, "amount_inr"))
def _drift(spark, sf_dir):
    return tidy(contract.behavioural_drift(tx(spark, sf_dir)))


@query("contract_peer_percentile", with_tx(
    f"select transaction_id, {round_sql('percent_rank() over (partition by peer_group_id order by amount_inr) * 100')} as peer_amount_percentile from tx",
    "transaction_id", "peer_group_id", "amount_inr"))
def _peer(spark, sf_dir):
    df = tx(spark, sf_dir).select("transaction_id", "peer_group_id", contract.paise().cast("bigint").alias("_paise"), "amount_inr")
    ranks = contract.peer_percentile(df)
    return tidy(contract.with_instants(df, ranks, ["peer_group_id", "_paise"]).select("transaction_id", "peer_amount_percentile"))


@query("contract_shared_device_accounts", with_tx(
    f"select transaction_id, coalesce(n, 0) as shared_device_accounts from tx left join (select device_fingerprint_hash as d, "
    f"count(distinct {A}) - 1 as n from tx where device_fingerprint_hash is not null group by 1) as k on device_fingerprint_hash = d",
    "transaction_id", A, "device_fingerprint_hash"))
def _shared(spark, sf_dir):
    df = tx(spark, sf_dir).select("transaction_id", A, "device_fingerprint_hash")
    shared = contract.shared_accounts(df, "device_fingerprint_hash", "shared_device_accounts")
    out = contract.with_instants(df, shared, ["device_fingerprint_hash"])
    return tidy(out.select("transaction_id", F.coalesce("shared_device_accounts", F.lit(0)).alias("shared_device_accounts")))


@query("contract_shared_ip_accounts", with_graph(
    "select transaction_id, n as shared_ip_accounts from g join (select ip_node_id as i, count(distinct account_id_hash) - 1 as n "
    "from g group by 1) as k on ip_node_id = i", []))
def _shared_ip(spark, sf_dir):
    df = graph_tx(spark, sf_dir).select("transaction_id", A, "ip_node_id")
    return tidy(contract.with_shared_accounts(df, "ip_node_id", "shared_ip_accounts").select("transaction_id", "shared_ip_accounts"))


_SAR = "(label_source = 'CONFIRMED_SAR' and label_is_fraud = 1)::int"


@query("contract_beneficiary_reports", with_tx(
    f"select distinct {B}, {_TIME}, n::bigint as beneficiary_sar_count from (select {B}, {T}, coalesce(sum({_SAR}) over (partition by {B} order by {T} "
    "range between unbounded preceding and interval '1 microsecond' preceding), 0) as n from tx) as q", B, T, "label_source", "label_is_fraud"))
def _reports(spark, sf_dir):
    return tidy(contract.prior_reports(tx(spark, sf_dir)))


@query("contract_second_hop_reports", with_tx(f""", pr as (select distinct a, b from (
  select {A} as a, {B} as b from tx where {A} <> {B} union all select {B}, {A} from tx where {A} <> {B}) as u
), s as (select {B} as n, sum({_SAR}) as sar from tx group by 1)
select p1.a as node_id, coalesce(sum(case when p2.b <> p1.a then s.sar end), 0)::bigint as second_hop_sar_count
from pr p1 join pr p2 on p1.b = p2.a left join s on s.n = p2.b group by 1""", A, B, "label_source", "label_is_fraud"))
def _second_hop(spark, sf_dir):
    df = materialize(tx(spark, sf_dir).select(A, B, "label_source", "label_is_fraud"), "transfers")
    ids = materialize(distinct_ids(df, A, B), "ids")
    seed = hash_seed(ids)
    df = shortened(df, seed, A, B)
    pairs = materialize(contract.undirected(df), "pairs")
    return restored(contract.second_hop_reports(pairs, contract.account_reports(df)), ids, seed, "node_id")


def _fan_sql(window, k):
    return with_tx(f""", o as (select distinct {A} as a, epoch_us({T}) as t, {B} as b from tx), c as (select distinct {B} as a, epoch_us({T}) as t from tx
), d as (select c.a, c.t from c join o on o.a = c.a and o.t >= c.t and o.t <= c.t + {window * 1000000} group by 1, 2 having count(distinct o.b) >= {k}
), x as (select distinct a, t from o)
select a as {A}, t as {T}, exists (select 1 from d where d.a = x.a and d.t <= x.t and d.t >= x.t - {window * 1000000}) as rapid_fan_out_flag from x""", A, B, T)


@query("contract_rapid_fan_out", _fan_sql(7200, 5))
def _fan_out(spark, sf_dir):
    return _fan(spark, sf_dir, 7200, 5)


@query("contract_fan_out_month", _fan_sql(30 * 86400, 3))
def _fan_out_month(spark, sf_dir):
    return _fan(spark, sf_dir, 30 * 86400, 3)


def _fan(spark, sf_dir, window, k):
    return tidy(contract.rapid_fan_out(tx(spark, sf_dir), window, k))


def _rank_sql(iterations):
    steps = [f", pr as (select distinct {A} as a, {B} as b from tx), nd as materialized (select n, (select nullif(count(*), 0) from pr where a = n) as deg from "
             "(select a as n from pr union select b from pr) as u), r0 as (select n, deg, 1e0 / (select count(*) from nd) as r from nd)"]
    for i in range(1, iterations + 1):
        steps.append(f", r{i} as materialized (select nd.n, nd.deg, 0.15e0 / (select count(*) from nd) + 0.85e0 * (coalesce(g.got, 0) + "
                     f"(select coalesce(sum(r), 0) from r{i-1} where deg is null) / (select count(*) from nd)) as r from nd left join "
                     f"(select pr.b as n, sum(s.r / s.deg) as got from pr join r{i-1} s on pr.a = s.n group by 1) g on g.n = nd.n)")
    return "".join(steps) + f"\nselect n as node_id, {round_sql(f'r / (select max(r) from r{iterations})')} as originator_graph_centrality from r{iterations}"


@query("contract_pagerank", with_tx(_rank_sql(5), A, B))
def _pagerank(spark, sf_dir):
    pairs = materialize(contract.directed(tx(spark, sf_dir)), "pairs")
    return tidy(contract.pagerank(pairs, 5, store=materialize))


# one rate per month and currency, from the months that occur in the orders
_RATES = "select distinct date_trunc('month', o_orderdate) as m from orders"


@query("contract_usd_equivalent", with_tx(f""", rt as (select c.currency, m as rate_ts, 70 + (month(m) * 7 + year(m)) % 23 + c.k as rate
  from ({_RATES}) as x, (values ('INR', 0e0), ('USD', 3e0)) as c(currency, k))
select transaction_id, {round_sql('amount_inr / rate', 4)} as amount_usd_equiv from tx asof left join rt
  on tx.currency = rt.currency and tx.transaction_dt >= rt.rate_ts""", "transaction_id", "currency", "amount_inr", T))
def _usd(spark, sf_dir):
    months = sample_view.table(spark, sf_dir, "orders").select(
        F.date_trunc("month", "o_orderdate").cast("timestamp").alias("rate_ts")).distinct()
    level = 70 + (F.month("rate_ts") * 7 + F.year("rate_ts")) % 23
    rates = months.withColumn("c", F.explode(F.array(*[
        F.struct(F.lit(n).alias("currency"), F.lit(k).alias("k")) for n, k in (("INR", 0.0), ("USD", 3.0))])))
    rates = rates.select("c.currency", "rate_ts", (level + F.col("c.k")).alias("rate"))
    df = tx(spark, sf_dir).select("transaction_id", "currency", "amount_inr", T)
    return tidy(contract.usd_equivalent(df, rates).select("transaction_id", "amount_usd_equiv"), 4)


_AGG = f"""select *, percent_rank() over (partition by peer_group_id order by amount_inr) * 100 as pp, {VELOCITY_SQL},
  count(distinct {B}) {_win('6 hours')} as d6, count(distinct {B}) {_win('24 hours')} as d24,
  count(distinct device_fingerprint_hash) {_win('30 days')} as dd,
  row_number() over (partition by {A}, {B} order by {T}, transaction_id) = 1 as nb,
  coalesce(epoch_us({T}) - epoch_us(lag({T}) over (partition by {A} order by {T}, transaction_id)) > 90 * 86400000000, false) as dorm,
  coalesce(sum({_SAR}) over (partition by {B} order by {T} range between unbounded preceding and interval '1 microsecond' preceding), 0) as sar
from (select * exclude (velocity_1h, velocity_6h, velocity_24h, velocity_7d, amount_sum_1h, amount_sum_24h, amount_mean_90d,
  amount_std_90d, typical_velocity_daily) from tx) as t0"""
_ENRICHED = f""", en as materialized (select w.* replace (pp as peer_amount_percentile, d6 as distinct_beneficiaries_6h, d24 as distinct_beneficiaries_24h,
  dd as distinct_devices_30d, nb as is_new_beneficiary, dorm as is_dormant_account, sar as beneficiary_sar_count,
  coalesce(k.n, 0) as shared_device_accounts) from ({_AGG}) as w left join (select device_fingerprint_hash as d, count(distinct {A}) - 1 as n
  from tx where device_fingerprint_hash is not null group by 1) as k on w.device_fingerprint_hash = k.d)
"""


@query("contract_enriched_features", with_tx(_ENRICHED + feature_sql(source="en")))
def _enriched(spark, sf_dir):
    # read once: the first step of enriching stores the rows
    return tidy(features.transform(contract.enrich(tx(spark, sf_dir), network=False), ["transaction_id"]))


# every column of the network from the finished table, against the queries of the single operators
@query("contract_enriched_network", "select * from (" + " union all ".join(
    f"select '{name}' as \"column\", 0::bigint as differing" for name in (
        "behavioural_drift_score", "originator_graph_centrality", "rapid_fan_out_flag", "second_hop_sar_count", "shared_ip_accounts")) + ") as q")
def _network(spark, sf_dir):
    """Rows on which the finished table and the single operators (checked by SQL themselves) differ."""
    df = materialize(tx(spark, sf_dir), "transactions")
    whole = materialize(contract.enrich(df), "enriched")
    ids = graph.with_graph_ids(df)
    pairs = materialize(contract.undirected(df), "pairs")
    directed = materialize(df.select(F.col(A).alias("a"), F.col(B).alias("b")).distinct(), "directed")
    single = [("behavioural_drift_score", contract.behavioural_drift(df), [A, T]),
              ("originator_graph_centrality", contract.pagerank(directed, store=materialize).withColumnRenamed("node_id", A), [A]),
              ("rapid_fan_out_flag", contract.rapid_fan_out(df), [A, T]),
              ("second_hop_sar_count", contract.second_hop_reports(pairs, contract.account_reports(df)).withColumnRenamed("node_id", A), [A]),
              ("shared_ip_accounts", ids.join(contract.shared_accounts(ids, "ip_node_id", "n"), "ip_node_id").select(
                  "transaction_id", F.col("n").alias("shared_ip_accounts")), ["transaction_id"])]
    out = None
    for name, table, keys in single:
        met = whole.select(*keys, F.col(name).cast("double").alias("got")).join(
            table.select(*keys, F.col(name).cast("double").alias("want")).distinct(), keys, "left")
        off = met.agg(F.count_if(F.abs(F.col("got") - F.coalesce("want", F.lit(0.0))) > 1e-9).alias("differing")).select(
            F.lit(name).alias("column"), "differing")
        out = off if out is None else out.unionByName(off)
    return out
