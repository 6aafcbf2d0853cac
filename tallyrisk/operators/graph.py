"""Node and edge tables of the transaction graph, and links between accounts that share an
entity. Every table is a grouped aggregate with map-side partial sums, so a key that holds a
third of the rows costs one group of partial results, not one huge task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window, functions as F

from .. import schema
from ..functions.scalars import at_least, clip, seconds_between, sha_hex, stable_int
from ..session import materialize
from .short_ids import packed, unpacked
from .timeline import KEY_ROWS, by_size, parted  # noqa: F401

# ---- Fixed values: the limits that `shared_entity_edges` takes on request ----
MAX_SHARED_EDGES = 250_000
CHAIN_LENGTH = 60


def with_graph_ids(tx: DataFrame, rows: int | None = None) -> DataFrame:
    """Add `ip_node_id` and `merchant_node_id`.

    An address is shared by every m-th row of an account, m = max(100, rows // 40). A table
    has no row numbers, so the slot comes from a hash of the transaction id, unless a
    `row_index` column gives it.
    """
    total = rows if rows is not None else tx.count()
    slots = max(100, total // 40)
    slot = F.col("row_index") % slots if "row_index" in tx.columns else stable_int(F.col("transaction_id"), slots)
    ip = sha_hex(F.concat(F.lit("ip-"), F.substring("account_id_hash", 1, 16), F.lit("-"), slot.cast("string")))
    merchant = F.concat(F.lit("mcc_"), F.coalesce("merchant_category_code", F.lit("UNKNOWN")))
    return tx.withColumns({"ip_node_id": ip, "merchant_node_id": merchant})


def _keyed(tx: DataFrame, *keys: str, also: Sequence[str] = ()) -> GroupedData:
    """Rows that have all keys, by key. Keys, and other ids, are `packed`: unpack the keys of the result."""
    present = [F.col(k).isNotNull() for k in keys]
    kept = tx
    for p in present:
        kept = kept.where(p)
    return packed(kept, *keys, *also).groupBy(*keys)


def _mode(column: str) -> Column:
    return F.mode(column, True)  # ties: smallest value


def _number(column: str) -> Column:
    return F.col(column).cast("double")


_SEEN = ["transaction_id", "transaction_dt", "amount_inr", "label_is_fraud", "label_source"]
_SENDER = ["days_since_account_open", "beneficiary_sar_count", "second_hop_sar_count", "typical_velocity_daily",
           "amount_mean_90d", "ip_reputation_score", "watchlist_hit", "synthetic_identity_score", "distinct_devices_30d",
           "failed_auth_count_7d"]


def _per_account(tx: DataFrame, key: str, columns: list[Column], names: Sequence[str] = ()) -> DataFrame:
    """The aggregates of each account. Partial states of modes and medians are wider than the rows they stand for, so
    the rows of ordinary accounts are shuffled themselves; accounts with very many rows are summed up before."""
    # of the transaction id only its presence counts
    rows = tx.where(F.col(key).isNotNull()).select(
        F.col(key).alias("node_id"), F.col("transaction_id").isNotNull().alias("_has"),
        *[c for c in dict.fromkeys([*_SEEN, *names]) if c != "transaction_id"])
    ordinary, heavy = by_size(rows, "node_id")
    parts = [part.withColumn("transaction_id", F.when(F.col("_has"), F.lit(1))).groupBy("node_id").agg(*columns)
             for part in (ordinary, heavy) if part is not None]
    return unpacked(parts[0] if heavy is None else parts[0].unionByName(parts[1]), rows, "node_id")


def account_roles(tx: DataFrame) -> DataFrame:
    """One row per account and role: what an account did as sender and as receiver. Give a stored table."""
    seen = [F.min("transaction_dt").alias("first_tx"), F.max("transaction_dt").alias("last_tx"),
            F.count("transaction_id").alias("lifetime_tx_count"), F.sum("amount_inr").alias("lifetime_amount"),
            F.max("label_is_fraud").alias("node_label"), _mode("label_source").alias("label_source")]
    sender = _per_account(tx, "account_id_hash", [
        *seen,
        F.median("days_since_account_open").alias("account_age_days"),
        F.max("beneficiary_sar_count").alias("prior_sar_count"),
        F.max("second_hop_sar_count").alias("prior_alert_count"),
        F.max("label_is_fraud").alias("prior_confirmed_fraud"),
        F.avg("typical_velocity_daily").alias("monthly_avg_tx_count"),
        F.avg("amount_mean_90d").alias("monthly_avg_amount"),
        F.avg("ip_reputation_score").alias("geographic_risk_score"),
        F.max(F.col("watchlist_hit").cast("int")).alias("pep_flag"),
        F.avg("synthetic_identity_score").alias("industry_risk_score"),
        F.max("distinct_devices_30d").alias("distinct_devices_90d"),
        F.avg("failed_auth_count_7d").alias("avg_failed_auth_monthly"),
    ], _SENDER)
    receiver = _per_account(tx, "beneficiary_id_hash", seen)
    # a side that never had a labelled source still names one
    return sender.unionByName(receiver, allowMissingColumns=True).withColumn(
        "label_source", F.coalesce("label_source", F.lit("SYNTHETIC")))


def account_nodes(tx: DataFrame) -> DataFrame:
    """Accounts in either role, merged, cleaned and bounded: the 17 account features."""
    rules = {"first_tx": F.min, "last_tx": F.max, "account_age_days": F.median,
             "lifetime_tx_count": F.sum, "lifetime_amount": F.sum, "prior_sar_count": F.max,
             "prior_alert_count": F.max, "prior_confirmed_fraud": F.max, "monthly_avg_tx_count": F.avg,
             "monthly_avg_amount": F.avg, "geographic_risk_score": F.avg, "pep_flag": F.max,
             "industry_risk_score": F.avg, "distinct_devices_90d": F.max,
             "avg_failed_auth_monthly": F.avg, "node_label": F.max}
    merged = account_roles(tx).groupBy("node_id").agg(
        *[rule(name).alias(name) for name, rule in rules.items()], _mode("label_source").alias("label_source"))

    def filled(name, default, low, high):
        return clip(F.coalesce(_number(name), F.lit(float(default))), low, high)

    age = filled("account_age_days", 365, 0.0, 36500.0)
    monthly_amount = F.log1p(F.coalesce(F.col("monthly_avg_amount"), F.col("lifetime_amount") / 12.0))
    columns = {
        "account_age_days": age,
        "kyc_tier": F.when(age > 730, 3).when(age > 90, 2).otherwise(1),
        "account_type": F.when(monthly_amount > 12.5, 1).otherwise(0),
        "relationship_years": clip(age / 365.0, 0.0, 100.0),
        "lifetime_tx_count": F.col("lifetime_tx_count"),
        "lifetime_amount_log": F.log1p(F.coalesce("lifetime_amount", F.lit(0.0))),
        "prior_sar_count": filled("prior_sar_count", 0, 0.0, 127.0),
        "prior_alert_count": filled("prior_alert_count", 0, 0.0, 32767.0),
        "prior_confirmed_fraud": F.coalesce("prior_confirmed_fraud", F.lit(0)).cast("int"),
        "monthly_avg_tx_count": F.coalesce(F.col("monthly_avg_tx_count"), F.col("lifetime_tx_count") / 12.0),
        "monthly_avg_amount_log": monthly_amount,
        "geographic_risk_score": filled("geographic_risk_score", 0.1, 0.0, 1.0),
        "pep_flag": F.coalesce("pep_flag", F.lit(0)),
        "industry_risk_score": filled("industry_risk_score", 0, 0.0, 1.0),
        "distinct_devices_90d": filled("distinct_devices_90d", 1, 0.0, 10000.0),
        "avg_failed_auth_monthly": filled("avg_failed_auth_monthly", 0, 0.0, 10000.0),
        "is_new_account": (age < 90).cast("int"),
        "node_label": F.coalesce("node_label", F.lit(0)).cast("int"),
    }
    ordered = ["node_id", *schema.ACCOUNT_FEATURES, "node_label"]
    return merged.select(*[columns[n].alias(n) if n in columns else F.col(n) for n in ordered],
                         "label_source", "first_tx", "last_tx")


def _latest(tx: DataFrame) -> DataFrame:
    """One row, found right away: rows that are read from a long plan are not shuffled twice in one job."""
    return F.broadcast(materialize(tx.agg(F.max("transaction_dt").alias("_now")), "latest"))


def device_nodes(tx: DataFrame) -> DataFrame:
    devices = _keyed(tx, "device_fingerprint_hash", also=["account_id_hash"]).agg(
        F.min("transaction_dt").alias("_first"),
        F.count_distinct("account_id_hash").alias("associated_account_count"),
        F.avg("behavioural_drift_score").alias("_risk"),
        F.max(F.col("is_tor_vpn_proxy").cast("int")).alias("has_root_jailbreak"))
    days = F.floor(at_least(seconds_between(F.col("_now"), F.col("_first")) / 86400, 0.0)).cast("int")
    return unpacked(devices, tx, "device_fingerprint_hash").crossJoin(_latest(tx)).select(
        F.col("device_fingerprint_hash").alias("node_id"), days.alias("first_seen_days_ago"),
        "associated_account_count", stable_int(F.col("device_fingerprint_hash"), 4).cast("int").alias("platform"),
        clip(F.col("_risk"), 0.0, 1.0).alias("device_risk_score"), "has_root_jailbreak")


def ip_nodes(tx: DataFrame) -> DataFrame:
    proxy = F.max(F.col("is_tor_vpn_proxy").cast("int"))
    ips = _keyed(tx, "ip_node_id", also=["account_id_hash"]).agg(
        clip(F.avg("ip_reputation_score"), 0.0, 1.0).alias("reputation_score"),
        proxy.alias("is_tor"), proxy.alias("is_vpn"), proxy.alias("is_proxy"),
        clip(F.avg(F.col("geo_country_mismatch").cast("double")), 0.0, 1.0).alias("country_risk_score"),
        F.count_distinct("account_id_hash").alias("associated_account_count"))
    return unpacked(ips, tx, "ip_node_id").withColumnRenamed("ip_node_id", "node_id")


def merchant_nodes(tx: DataFrame) -> DataFrame:
    """Merchants by category code. Rows without a code form no node, but they do count in the
    risk of a node id they share."""
    sums = tx.groupBy("merchant_node_id", "merchant_category_code").agg(
        F.sum(_number("label_is_fraud")).alias("frauds"), F.count("label_is_fraud").alias("labelled"),
        F.sum("second_hop_sar_count").alias("disputes"))
    risk = sums.groupBy("merchant_node_id").agg((F.sum("frauds") / F.sum("labelled")).alias("risk"))
    nodes = sums.where(F.col("merchant_category_code").isNotNull()).join(risk, "merchant_node_id")
    return nodes.select(
        F.col("merchant_node_id").alias("node_id"), F.col("merchant_category_code").alias("mcc_code"),
        (30 + stable_int(F.col("merchant_node_id"), 3650)).cast("int").alias("merchant_age_days"),
        clip(F.coalesce("risk", F.lit(0.0)), 0.0, 1.0).alias("mcc_risk_score"),
        clip(F.col("frauds") / F.col("labelled"), 0.0, 1.0).alias("chargeback_rate_90d"),
        clip(F.coalesce("disputes", F.lit(0)), 0, 32767).cast("int").alias("dispute_count_90d"))


def _ends(src: str, dst: str) -> list[Column]:
    return [F.col(src).alias("src_node_id"), F.col(dst).alias("dst_node_id")]


def _hours_ago(last: str) -> Column:
    return at_least(seconds_between(F.col("_now"), F.col(last)) / 3600, 0.0)


def transfer_edges(tx: DataFrame) -> DataFrame:
    """Account to beneficiary. The window names are historic: the whole input counts."""
    ends = ["account_id_hash", "beneficiary_id_hash"]
    pairs = _keyed(tx, *ends).agg(
        F.count("transaction_id").alias("transaction_count_30d"), F.sum("amount_inr").alias("_sum"),
        F.min("transaction_dt").alias("_first"), F.max("transaction_dt").alias("_last"),
        F.avg("amount_inr").alias("_avg"), F.avg(_number("label_is_fraud")).alias("edge_risk_score"))
    return unpacked(pairs, tx, *ends).crossJoin(_latest(tx)).select(
        *_ends(*ends), "transaction_count_30d",
        F.log1p("_sum").alias("total_amount_30d_log"),
        at_least(seconds_between(F.col("_now"), F.col("_first")) / 86400, 0.0).alias("first_transaction_days_ago"),
        _hours_ago("_last").alias("last_transaction_hours_ago"),
        F.log1p("_avg").alias("avg_amount_log"),
        (F.col("transaction_count_30d") >= 2).cast("int").alias("is_recurring"), "edge_risk_score")


def device_edges(tx: DataFrame) -> DataFrame:
    """Account to device; the most used device is primary, ties go to the smallest id.

    The rows of an ordinary account are shuffled once and ranked where they lie. For accounts with very
    many rows the primary device is an aggregate joined back on both ends, so their devices are never
    sorted as one group.
    """
    src, dst = "account_id_hash", "device_fingerprint_hash"
    rows = tx.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        src, dst, F.col("transaction_id").isNotNull().alias("_has"), "transaction_dt")
    sums = [F.count_if("_has").alias("session_count_30d"), F.max("transaction_dt").alias("_last")]
    ordinary, heavy = by_size(rows, src, dst)
    # ties go by the text of an id, not by its bytes
    ranked = unpacked(ordinary.groupBy(src, dst).agg(*sums), rows, dst)
    order = Window.partitionBy(src).orderBy(F.desc("session_count_30d"), dst)
    edges = unpacked(ranked.withColumn("is_primary_device", (F.row_number().over(order) == 1).cast("int")), rows, src)
    if heavy is not None:
        far = unpacked(heavy.groupBy(src, dst).agg(*sums), rows, src, dst)
        best = far.groupBy(src).agg(
            F.min(F.struct((-F.col("session_count_30d")).alias("n"), F.col(dst).alias("d"))).alias("b")
        ).select(src, F.col("b.d").alias(dst), F.lit(1).alias("_primary"))
        edges = edges.unionByName(far.join(best, [src, dst], "left").withColumn(
            "is_primary_device", F.coalesce("_primary", F.lit(0))).drop("_primary"))
    return edges.crossJoin(_latest(tx)).select(
        *_ends(src, dst), "session_count_30d", _hours_ago("_last").alias("last_session_hours_ago"), "is_primary_device")


def ip_edges(tx: DataFrame) -> DataFrame:
    ends = ["account_id_hash", "ip_node_id"]
    pairs = _keyed(tx, *ends).agg(
        F.count("transaction_id").alias("session_count_7d"), F.max("transaction_dt").alias("_last"))
    return unpacked(pairs, tx, *ends).crossJoin(_latest(tx)).select(
        *_ends(*ends), "session_count_7d",
        _hours_ago("_last").alias("last_session_hours_ago"))


def merchant_edges(tx: DataFrame) -> DataFrame:
    ends = ["account_id_hash", "merchant_node_id"]
    pairs = _keyed(tx, *ends).agg(
        F.count("transaction_id").alias("transaction_count_90d"), F.sum("amount_inr").alias("_sum"))
    return unpacked(pairs, tx, *ends).select(
        *_ends(*ends), "transaction_count_90d",
        F.log1p("_sum").alias("total_amount_90d_log"),
        (F.col("transaction_count_90d") == 1).cast("int").alias("is_first_transaction"))


def entity_chain(edges: DataFrame, relation: str, cap: int | None = None, length: int | None = None) -> DataFrame:
    """Consecutive pairs among the accounts of each entity, in id order.

    The accounts of an ordinary entity lie in one task. A hub's accounts are cut into tiles by the first
    two characters of the id: pairs inside a tile come from a window over the tile, and the last account
    of a tile is followed by the first one of the next. With `length` only the first accounts of an
    entity take part, with `cap` only the first pairs in entity order; both are off by default.
    """
    pairs = edges.select(F.col("src_node_id").alias("_a"), F.col("dst_node_id").alias("_e"))
    ends = packed(pairs, "_a", "_e")
    per_entity = Window.partitionBy("_e").orderBy("_a")
    following = F.lead("_a").over(per_entity)
    if length is not None:
        # the rank filter runs per map task first, so a hub sends at most `length` accounts from each
        ends = unpacked(ends.distinct(), pairs, "_a")
        ends = ends.withColumn("_rank", F.row_number().over(per_entity)).where(F.col("_rank") <= length).drop("_rank")
        chain = ends.withColumn("_next", following)
    else:
        # the order is that of the texts, made where the accounts of an entity lie
        ordinary, hubs = parted(ends, ["_e"])
        chain = unpacked(ordinary.repartition("_e").distinct(), pairs, "_a").withColumn("_next", following).select("_a", "_e", "_next")
        if hubs is not None:
            chain = chain.unionByName(_tiled_chain(unpacked(hubs.distinct(), pairs, "_a")))
    chain = unpacked(chain.where(F.col("_next").isNotNull()), pairs, "_e").select(
        F.col("_a").alias("src_node_id"), F.col("_next").alias("dst_node_id"), F.lit(relation).alias("relation"),
        F.col("_e").alias("shared_entity_id"))
    return chain if cap is None else chain.orderBy("shared_entity_id", "src_node_id").limit(cap)


def _tiled_chain(ends: DataFrame) -> DataFrame:
    """Each account of an entity (_a, _e) and the one after it; NULL after the last."""
    inside = Window.partitionBy("_e", "_tile").orderBy("_a")
    near = ends.withColumn("_tile", F.substring("_a", 1, 2)).withColumns({
        "_next": F.lead("_a").over(inside), "_first": F.first("_a").over(inside)})
    across = Window.partitionBy("_e").orderBy("_tile")
    far = near.where(F.col("_next").isNull()).withColumn("_next", F.lead("_first").over(across))
    return near.where(F.col("_next").isNotNull()).select("_a", "_e", "_next").unionByName(far.select("_a", "_e", "_next"))


def shared_entity_edges(device: DataFrame, ip: DataFrame, merchant: DataFrame,
                        max_edges: int | None = None, length: int | None = None) -> DataFrame:
    """Account pairs that share a device, an address or a merchant category."""
    # the first pair of a relation is emitted even when its share of the cap is zero
    cap = None if max_edges is None else max(1, max_edges // 3)
    parts = [("SHARES_DEVICE", device, 0), ("SHARES_IP", ip, 1), ("SHARES_MERCHANT", merchant, 2)]
    chains = [entity_chain(edges, name, cap, length).withColumn("_part", F.lit(part)) for name, edges, part in parts]
    union = chains[0].unionByName(chains[1]).unionByName(chains[2])
    names = ["src_node_id", "dst_node_id", "relation", "shared_entity_id"]
    if max_edges is not None and max_edges <= 0:
        return union.limit(0).select(*names)
    if max_edges is not None and max_edges < 3:
        union = union.orderBy("_part", "shared_entity_id", "src_node_id").limit(max_edges)
    # no pair occurs twice: an account stands once in an entity and has one that follows it
    return union.select(*names)


def build_graph(tx: DataFrame, max_edges: int | None = None, length: int | None = None) -> dict[str, DataFrame]:
    """All nine tables of the graph. Give a cached or stored table: each one reads it again."""
    tx = with_graph_ids(tx)
    device, ip, merchant = device_edges(tx), ip_edges(tx), merchant_edges(tx)
    return {
        "account_nodes": account_nodes(tx), "device_nodes": device_nodes(tx),
        "ip_nodes": ip_nodes(tx), "merchant_nodes": merchant_nodes(tx),
        "account_account_edges": transfer_edges(tx), "account_device_edges": device,
        "account_ip_edges": ip, "account_merchant_edges": merchant,
        "derived_account_edges": shared_entity_edges(device, ip, merchant, max_edges, length),
    }
