"""The order tables read as payment transactions.

`columns(dialect)` states every transaction column as one SQL expression over an order line
and its order; the same text serves Spark and the comparison engine, with a handful of
dialect words swapped. Rates of NULLs, zeros and flags are chosen so that every imputation
and zero-replacement rule meets real rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema


class SparkWords:
    text, integer, whole = "string", "int", "bigint"

    @staticmethod
    def sha(x):
        return f"sha2({x}, 256)"

    @staticmethod
    def pick(values, index):
        items = ", ".join(f"'{v}'" for v in values)
        return f"element_at(array({items}), cast(1 + {index} as int))"

    @staticmethod
    def plus_seconds(ts, s):
        return f"cast({ts} + make_dt_interval(0, 0, 0, {s}) as timestamp)"

    @staticmethod
    def div(a, b):
        return f"({a}) div {b}"


class DuckWords:
    text, integer, whole = "varchar", "integer", "bigint"

    @staticmethod
    def sha(x):
        return f"sha256({x})"

    @staticmethod
    def pick(values, index):
        items = ", ".join(f"'{v}'" for v in values)
        return f"list_extract([{items}], 1 + {index})"

    @staticmethod
    def plus_seconds(ts, s):
        return f"({ts} + to_seconds({s}))"

    @staticmethod
    def div(a, b):
        return f"({a}) // {b}"


def columns(d) -> dict[str, str]:
    price = f"cast(round(l_extendedprice * 100) as {d.whole})"
    share = f"(100 - cast(round(l_discount * 100) as {d.whole}))"
    paise = d.div(f"{price} * {share} * 15", 100)
    fraud = "(l_returnflag = 'R' and l_discount >= 0.0595e0)"
    v1, v6 = "(l_orderkey % 4)", "(l_orderkey % 4 + l_partkey % 3)"
    v24 = "(l_orderkey % 4 + l_partkey % 3 + l_suppkey % 4)"

    def num(x):
        return f"cast({x} as {d.integer})"

    return {
        "transaction_id": f"concat_ws('-', cast(l_orderkey as {d.text}), cast(l_linenumber as {d.text}), "
                          f"cast(l_partkey as {d.text}), cast(l_suppkey as {d.text}), cast({price} as {d.text}))",
        "account_id_hash": d.sha(f"concat('acct-', cast(o_custkey as {d.text}))"),
        "beneficiary_id_hash": d.sha(f"concat('acct-', cast(l_suppkey as {d.text}))"),
        "device_fingerprint_hash": "case when l_partkey % 53 = 0 then null else "
                                   + d.sha(f"concat('device-', cast(l_partkey % 400 as {d.text}))") + " end",
        "transaction_dt": d.plus_seconds(
            "l_shipdate", "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 86400"),
        "amount_inr": f"({paise}) / 100e0",
        "amount_usd_equiv": f"({paise}) / 8300e0",
        "channel": d.pick(schema.CHANNELS, "l_orderkey % 9"),
        "merchant_category_code": "case when l_partkey % 59 = 0 then null else "
                                  + d.pick(schema.MCC_CODES, "l_partkey % 10") + " end",
        "is_international": "(l_suppkey % 12 = 0)",
        "currency": "case when l_suppkey % 12 = 0 then 'USD' else 'INR' end",
        "is_new_beneficiary": "case when l_orderkey % 109 = 0 then null else l_linenumber = 1 end",
        "days_since_account_open": num("(o_custkey * 7) % 3650"),
        "velocity_1h": num(v1),
        "velocity_6h": num(v6),
        "velocity_24h": num(v24),
        "velocity_7d": num(f"{v24} + l_linenumber"),
        "amount_sum_1h": f"({paise}) * {v1} / 100e0",
        "amount_sum_24h": f"({paise}) * (1 + {v24}) / 100e0",
        "distinct_beneficiaries_6h": num("l_orderkey % 3"),
        "distinct_beneficiaries_24h": num("l_orderkey % 3 + l_linenumber % 2"),
        "ip_reputation_score": "case when l_orderkey % 97 = 0 then null else (l_partkey % 101) / 100e0 end",
        "is_tor_vpn_proxy": "(l_partkey % 17 = 0)",
        "geo_distance_km": "((l_orderkey * 13) % 20000) * 1e0",
        "geo_country_mismatch": "(l_orderkey % 29 = 0)",
        "watchlist_hit": "(l_suppkey % 50 = 0)",
        "watchlist_category": "case when l_suppkey % 50 = 0 then 'PEP_TIER1' else 'NONE' end",
        "failed_auth_count_7d": f"case when l_orderkey % 89 = 0 then null else {num('l_linenumber % 7')} end",
        "amount_mean_90d": "case when l_orderkey % 71 = 0 then null else ((l_partkey * 37) % 90000) * 10e0 end",
        "amount_std_90d": "case when l_partkey % 41 = 0 then 0e0 when l_orderkey % 73 = 0 then null "
                          "else 1009e0 + (l_suppkey % 20) * 2503e0 end",
        "typical_velocity_daily": "case when l_suppkey % 31 = 0 then 0e0 when l_orderkey % 67 = 0 then null "
                                  "else (l_partkey % 50) / 8e0 end",
        "is_dormant_account": "case when l_orderkey % 101 = 0 then null else l_partkey % 23 = 0 end",
        "distinct_devices_30d": f"case when l_orderkey % 79 = 0 then null else {num('1 + l_linenumber % 5')} end",
        "behavioural_drift_score": "case when l_orderkey % 83 = 0 then null else l_tax * 10 end",
        "peer_group_id": f"concat('PG-', lpad(cast(1 + o_custkey % 35 as {d.text}), 3, '0'))",
        "peer_amount_percentile": "case when l_orderkey % 61 = 0 then null else (l_partkey % 1000) / 10e0 end",
        "shared_device_accounts": num("l_partkey % 7"),
        "shared_ip_accounts": num("l_orderkey % 5"),
        "beneficiary_sar_count": f"case when l_orderkey % 103 = 0 then null when l_suppkey % 9 = 0 "
                                 f"then {num('l_partkey % 4')} else 0 end",
        "second_hop_sar_count": f"case when l_orderkey % 11 = 0 then {num('l_linenumber')} else 0 end",
        "mule_network_probability": "(l_suppkey % 50) / 100e0",
        "synthetic_identity_score": "(o_custkey % 100) / 100e0",
        "rapid_fan_out_flag": "(l_orderkey % 37 = 0)",
        "originator_graph_centrality": "(o_custkey % 90) / 100e0",
        "label_is_fraud": f"case when {fraud} then 1 else 0 end",
        "label_typology": f"case when {fraud} then " + d.pick(["ATO-04", "STR-09", "MML-02"], "l_partkey % 3")
                          + " else 'BENIGN' end",
        "label_source": d.pick(schema.LABEL_SOURCES, "l_suppkey % 6"),
        "label_confidence": "case l_suppkey % 6 when 0 then 0.95e0 when 5 then 0.7e0 else 0.85e0 end",
    }


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 48 columns, one row per order line."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # both sides grow alike: a shuffled join keeps the width of the cluster where a small
    # single-file sample would otherwise run as one task
    joined = lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(*[F.expr(text).alias(name) for name, text in columns(SparkWords).items()])


def duck_transactions(*names: str) -> str:
    """The same rows as a query for the comparison engine."""
    wanted = columns(DuckWords)
    picked = ",\n  ".join(f"{wanted[n]} as {n}" for n in (names or wanted))
    return f"select\n  {picked}\nfrom lineitem join orders on l_orderkey = o_orderkey"


def account_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per customer account, for the operators that take scores as given.

    Three accounts in four have one; probabilities step by 1/997.
    """
    accounts = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 3")
    return accounts.selectExpr(
        "sha2(concat('acct-', cast(c_custkey as string)), 256) as account_id_hash",
        "((c_custkey * 31) % 998) / 997e0 as gnn_fraud_probability",
    )


DUCK_SCORES = """select sha256(concat('acct-', cast(c_custkey as varchar))) as account_id_hash,
  ((c_custkey * 31) % 998) / 997e0 as gnn_fraud_probability
from customer where c_custkey % 4 <> 3"""
