"""The transaction contract: one spec per column drives types, quality rules and imputation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---- Fixed values: every entry below is part of the data contract -----------------------

CHANNELS = ["IMPS", "NEFT", "RTGS", "UPI", "CARD_CP", "CARD_CNP", "WIRE", "CRYPTO", "P2P"]
MODEL_CHANNELS = ["IMPS", "UPI", "CARD_CNP", "WIRE", "CRYPTO"]
CURRENCIES = ["INR", "USD", "EUR", "GBP", "AED", "SGD"]
MCC_CODES = ["5411", "5812", "5999", "6012", "6211", "6536", "7995", "4829", "5734", "7399"]
WATCHLISTS = ["OFAC_SDN", "UN_CONSOLIDATED", "PEP_TIER1", "PEP_TIER2", "FIU_IND", "INTERNAL", "NONE"]
LABEL_SOURCES = ["CONFIRMED_SAR", "INVESTIGATOR", "CARD_NETWORK", "NPCI", "CONSORTIUM", "SYNTHETIC"]
TYPOLOGIES = ["BENIGN", "ATO-04", "STR-09", "MML-02", "CNP-11", "SID-06", "BEC-13", "TBML-07",
              "CRY-15", "ROM-17", "UPI-21", "FPF-03"]

CLASS_WEIGHTS = {0: 1.0, 1: 2.33}
SOURCE_WEIGHTS = {"CONFIRMED_SAR": 1.5, "INVESTIGATOR": 1.2, "CARD_NETWORK": 1.1,
                  "NPCI": 1.1, "CONSORTIUM": 0.9, "SYNTHETIC": 0.7}
REPORTING_THRESHOLD_INR = 1_000_000

NULL_TOLERANCE = 0.01
MIN_FRAUD_RATE = 0.05

NULL_DEFAULTS = {
    "ip_reputation_score": 0.5,
    "geo_distance_km": 0.0,
    "behavioural_drift_score": 0.0,
    "peer_amount_percentile": 50.0,
    "mule_network_probability": 0.0,
    "synthetic_identity_score": 0.0,
    "originator_graph_centrality": 0.0,
    "second_hop_sar_count": 0,
    "beneficiary_sar_count": 0,
    "distinct_devices_30d": 1,
    "failed_auth_count_7d": 0,
    "shared_device_accounts": 0,
    "shared_ip_accounts": 0,
    "amount_mean_90d": 0.0,
    "amount_std_90d": 1.0,
    "typical_velocity_daily": 1.0,
}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    allowed: tuple | None = None
    identity: bool = False


def _text(name, nullable=False, allowed=None, identity=False):
    return Column(name, "string", nullable, allowed=tuple(allowed) if allowed else None, identity=identity)


def _count(name, high):
    return Column(name, "int", low=0, high=high)


def _real(name, low=None, high=None, identity=False):
    return Column(name, "double", low=low, high=high, identity=identity)


def _flag(name):
    return Column(name, "boolean")


TRANSACTION = [
    _text("transaction_id", identity=True),
    _text("account_id_hash", identity=True),
    _text("beneficiary_id_hash", identity=True),
    _text("device_fingerprint_hash", nullable=True, identity=True),
    Column("transaction_dt", "timestamp", identity=True),
    _real("amount_inr", 0.01, 1e8),
    _real("amount_usd_equiv", 0.001, 1.2e6),
    _text("channel", allowed=CHANNELS),
    _text("merchant_category_code", nullable=True),
    _flag("is_international"),
    _text("currency"),
    _flag("is_new_beneficiary"),
    _count("days_since_account_open", 36500),
    _count("velocity_1h", 10000),
    _count("velocity_6h", 50000),
    _count("velocity_24h", 200000),
    _count("velocity_7d", 1e6),
    _real("amount_sum_1h", 0, 1e10),
    _real("amount_sum_24h", 0, 1e11),
    _count("distinct_beneficiaries_6h", 5000),
    _count("distinct_beneficiaries_24h", 20000),
    _real("ip_reputation_score", 0.0, 1.0),
    _flag("is_tor_vpn_proxy"),
    _real("geo_distance_km", 0, 40000),
    _flag("geo_country_mismatch"),
    _flag("watchlist_hit"),
    _text("watchlist_category", nullable=True, allowed=WATCHLISTS),
    _count("failed_auth_count_7d", 1000),
    _real("amount_mean_90d"),
    _real("amount_std_90d"),
    _real("typical_velocity_daily"),
    _flag("is_dormant_account"),
    _count("distinct_devices_30d", 200),
    _real("behavioural_drift_score", 0.0, 1.0),
    _text("peer_group_id", nullable=True, identity=True),
    _real("peer_amount_percentile", 0.0, 100.0),
    _count("shared_device_accounts", 10000),
    _count("shared_ip_accounts", 10000),
    _count("beneficiary_sar_count", 1000),
    _count("second_hop_sar_count", 5000),
    _real("mule_network_probability", 0.0, 1.0),
    _real("synthetic_identity_score", 0.0, 1.0),
    _flag("rapid_fan_out_flag"),
    _real("originator_graph_centrality", 0.0, 1.0),
    Column("label_is_fraud", "int", allowed=(0, 1)),
    _text("label_typology", allowed=TYPOLOGIES),
    _text("label_source", allowed=LABEL_SOURCES, identity=True),
    _real("label_confidence", 0.5, 1.0, identity=True),
]

FEATURES = [
    # amounts
    "amount_inr_log", "amount_usd_equiv_log", "amount_zscore",
    "amount_sum_1h_log", "amount_sum_24h_log", "ctr_proximity",
    # velocity
    "velocity_1h", "velocity_6h", "velocity_24h", "velocity_7d",
    "velocity_ratio_1h_24h", "amount_per_tx_1h", "distinct_bene_6h", "distinct_bene_24h",
    # calendar
    "hour_of_day", "day_of_week", "is_weekend", "is_nighttime", "is_month_end",
    # channel
    "channel_IMPS", "channel_UPI", "channel_CARD_CNP", "channel_WIRE", "channel_CRYPTO",
    "is_international",
    # geography and device
    "geo_distance_km_log", "geo_country_mismatch", "is_tor_vpn_proxy",
    "ip_reputation_score", "failed_auth_count_7d", "distinct_devices_30d",
    # behaviour
    "velocity_vs_baseline", "behavioural_drift_score", "is_dormant_account",
    "days_since_acct_open_log", "is_new_beneficiary", "peer_amount_percentile", "watchlist_hit",
    # entity graph
    "shared_device_accounts_log", "shared_ip_accounts_log",
    "beneficiary_sar_count", "second_hop_sar_count", "mule_network_probability",
    "synthetic_identity_score", "rapid_fan_out_flag", "originator_graph_centrality",
]

# engineered graph feature -> raw column it explains
GRAPH_FEATURES = {
    "shared_device_accounts_log": "shared_device_accounts",
    "shared_ip_accounts_log": "shared_ip_accounts",
    "beneficiary_sar_count": "beneficiary_sar_count",
    "second_hop_sar_count": "second_hop_sar_count",
    "mule_network_probability": "mule_network_probability",
    "synthetic_identity_score": "synthetic_identity_score",
    "rapid_fan_out_flag": "rapid_fan_out_flag",
    "originator_graph_centrality": "originator_graph_centrality",
}
GRAPH_COLUMNS = list(GRAPH_FEATURES.values())
OPTIONAL_SCORE_COLUMNS = ["gnn_fraud_probability", "gnn_risk_score"]

ACCOUNT_FEATURES = [
    "account_age_days", "kyc_tier", "account_type", "relationship_years",
    "lifetime_tx_count", "lifetime_amount_log", "prior_sar_count", "prior_alert_count",
    "prior_confirmed_fraud", "monthly_avg_tx_count", "monthly_avg_amount_log",
    "geographic_risk_score", "pep_flag", "industry_risk_score",
    "distinct_devices_90d", "avg_failed_auth_monthly", "is_new_account",
]

DEPLOYMENT_GATES = [
    ("auc", ">=", 0.94),
    ("pr_auc", ">=", 0.80),
    ("f1_macro", ">=", 0.87),
    ("fp_rate", "<=", 0.04),
    ("brier", "<=", 0.05),
    ("ece", "<=", 0.05),
]

# ---- Derived from the table above -------------------------------------------------------

_SPARK = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def transaction_schema() -> T.StructType:
    return T.StructType([T.StructField(c.name, _SPARK[c.kind], True) for c in TRANSACTION])


def transaction_columns() -> list[str]:
    return [c.name for c in TRANSACTION]


def raw_feature_columns() -> list[str]:
    """Columns a model may see before engineering: neither identity nor label."""
    return [c.name for c in TRANSACTION if not c.identity and not c.name.startswith("label_")]


def boolean_columns() -> list[str]:
    return [c.name for c in TRANSACTION if c.kind == "boolean"]
