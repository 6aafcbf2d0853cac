"""Imputation, the 46 model features, sample weights and graph modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..functions.scalars import as_number, clip, literal_lookup, zero_to


def imputed(df: DataFrame) -> dict[str, Column]:
    """Each column as the features read it: defaults for NULLs where the contract names one."""
    out = {name: F.col(name) for name in df.columns}
    for name, default in schema.NULL_DEFAULTS.items():
        if name in out:
            out[name] = F.coalesce(out[name], F.lit(default))
    for name in schema.boolean_columns():
        if name in out:
            out[name] = F.coalesce(out[name], F.lit(False))
    return out


def impute(df: DataFrame) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in imputed(df).items()])


def feature_columns(c: dict[str, Column]) -> dict[str, Column]:
    """The 46 features in model order, from imputed raw columns."""
    amount, at = c["amount_inr"], c["transaction_dt"]
    threshold = float(schema.REPORTING_THRESHOLD_INR)
    hour, weekday = F.hour(at), F.weekday(at)
    per_hour = zero_to(c["velocity_24h"] / 24, 0.001)
    usual = zero_to(c["typical_velocity_daily"] / 24, 0.001)

    made = {
        "amount_inr_log": F.log1p(amount),
        "amount_usd_equiv_log": F.log1p(c["amount_usd_equiv"]),
        "amount_zscore": clip((amount - c["amount_mean_90d"]) / zero_to(c["amount_std_90d"], 1.0), -10.0, 10.0),
        "amount_sum_1h_log": F.log1p(c["amount_sum_1h"]),
        "amount_sum_24h_log": F.log1p(c["amount_sum_24h"]),
        "ctr_proximity": clip(1.0 - F.abs(amount - threshold) / threshold, 0.0, 1.0),
        "velocity_ratio_1h_24h": clip(c["velocity_1h"] / per_hour, 0.0, 1000.0),
        "amount_per_tx_1h": F.log1p(c["amount_sum_1h"] / zero_to(c["velocity_1h"], 1)),
        "distinct_bene_6h": c["distinct_beneficiaries_6h"],
        "distinct_bene_24h": c["distinct_beneficiaries_24h"],
        "hour_of_day": hour,
        "day_of_week": weekday,
        "is_weekend": weekday >= 5,
        "is_nighttime": (hour < 6) | (hour >= 22),
        "is_month_end": F.dayofmonth(at) >= 28,
        "geo_distance_km_log": F.log1p(c["geo_distance_km"]),
        "velocity_vs_baseline": clip(c["velocity_1h"] / usual, 0.0, 500.0),
        "days_since_acct_open_log": F.log1p(c["days_since_account_open"]),
        "shared_device_accounts_log": F.log1p(c["shared_device_accounts"]),
        "shared_ip_accounts_log": F.log1p(c["shared_ip_accounts"]),
    }
    for channel in schema.MODEL_CHANNELS:
        # an unknown or missing channel sets no flag
        made[f"channel_{channel}"] = F.coalesce(c["channel"] == channel, F.lit(False))
    # every feature without a rule of its own is the raw column of that name
    return {name: as_number(made[name] if name in made else c[name]) for name in schema.FEATURES}


def transform(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The feature table: the kept columns plus 46 doubles, in one projection."""
    raw = imputed(df)
    needed = [n for n in schema.raw_feature_columns()
              if n not in ("currency", "merchant_category_code", "watchlist_category")] + ["transaction_dt"]
    missing = [n for n in needed if n not in raw]
    if missing:
        raise ValueError(f"columns missing for the features: {missing}")
    made = feature_columns(raw)
    return df.select(*[F.col(k) for k in keep or []], *[c.alias(n) for n, c in made.items()])


def engineered_table(df: DataFrame) -> DataFrame:
    """transaction_id, the 46 features, label (0 where there is none)."""
    label = F.col("label_is_fraud") if "label_is_fraud" in df.columns else F.lit(0)
    out = transform(df.withColumn("_label", label.cast("int")), ["transaction_id", "_label"])
    return out.select("transaction_id", *schema.FEATURES, F.col("_label").alias("label_is_fraud"))


def raw_weight() -> Column:
    label = literal_lookup(F.col("label_is_fraud"), schema.CLASS_WEIGHTS, 1.0)
    source = literal_lookup(F.col("label_source"), schema.SOURCE_WEIGHTS, 1.0)
    return label * source * F.coalesce(F.col("label_confidence"), F.lit(1.0))


def sample_weights(df: DataFrame) -> DataFrame:
    """Add `sample_weight`, scaled so that its mean over the table is 1."""
    mean = df.agg(F.avg(raw_weight()).alias("_mean"))  # one row
    return df.crossJoin(F.broadcast(mean)).withColumn("sample_weight", raw_weight() / F.col("_mean")).drop("_mean")


def without_graph(df: DataFrame) -> DataFrame:
    """The baseline without graph knowledge: all eight graph columns neutral."""
    kinds = {c.name: c.kind for c in schema.TRANSACTION}
    neutral = {"int": F.lit(0), "double": F.lit(0.0), "boolean": F.lit(False)}
    return df.withColumns({name: neutral[kinds[name]] for name in schema.GRAPH_COLUMNS})


def apply_graph_mode(df: DataFrame, mode: str = "synthetic", scores: DataFrame | None = None) -> DataFrame:
    mode = (mode or "synthetic").lower()
    if mode == "synthetic":
        return df
    if mode == "none":
        return without_graph(df)
    if mode == "gnn_scores":
        if scores is None:
            raise ValueError("mode gnn_scores needs a table of account scores")
        from .inject import inject_scores
        return inject_scores(df, scores)
    raise ValueError("graph mode must be synthetic, none or gnn_scores")


def graph_findings(df: DataFrame) -> Column:
    """The graph columns present in the table, as one struct."""
    names = [n for n in schema.GRAPH_COLUMNS + schema.OPTIONAL_SCORE_COLUMNS if n in df.columns]
    return F.struct(*[F.col(n) for n in names])
