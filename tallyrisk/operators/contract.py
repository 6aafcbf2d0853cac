"""The behavioural columns the transaction contract expects, computed from plain rows.

Readings used here: look-backs include the current instant and both ends; "earlier" means a
strictly earlier instant; money is summed in whole paise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import haversine_km
from ..session import discard, materialize
from .graph import with_graph_ids
from .short_ids import distinct_ids, hash_seed, packed, restored, shortened, unpacked
from .skew import heavy_keys, spread_join
from .timeline import (DAY, HOUR, MICROS, TILE_SECONDS, after_gap, by_size, parted, previous_instant, rolling_distinct,
                       rolling_distincts, rolling_sums, running_totals, time_tile)

ACCOUNT, TS, ID = "account_id_hash", "transaction_dt", "transaction_id"
VELOCITY = {"1h": HOUR, "6h": 6 * HOUR, "24h": DAY, "7d": 7 * DAY}
DRIFT_BUCKETS = 8


def paise(amount: str = "amount_inr") -> Column:
    return F.round(F.col(amount) * 100).cast("decimal(20,0)")


def velocities(tx: DataFrame) -> DataFrame:
    """Counts over 1 h, 6 h, 24 h, 7 d; sums over 1 h, 24 h; mean, deviation and daily rate over
    90 days. One row per (account, instant)."""
    money = paise()
    sums = rolling_sums(tx, ACCOUNT, TS, {
        "n": F.lit(1).cast("bigint"), "s": money.cast("decimal(38,0)"), "q": (money * money).cast("decimal(38,0)"),
    }, {**VELOCITY, "90d": 90 * DAY})
    n, s, q = F.col("n_90d"), F.col("s_90d"), F.col("q_90d")
    # n * sum of squares - square of sum: exact in whole numbers, so equal amounts give zero
    spread = (n.cast("decimal(12,0)").cast("double") * q.cast("double") - s.cast("double") * s.cast("double"))
    exact = F.try_subtract(F.try_multiply(n.cast("decimal(10,0)"), q), F.try_multiply(s, s)).cast("double")
    spread = F.greatest(F.coalesce(exact, spread), F.lit(0.0))
    return sums.select(
        ACCOUNT, TS, *[F.col(f"n_{h}").cast("int").alias(f"velocity_{h}") for h in VELOCITY],
        *[(F.col(f"s_{h}").cast("double") / 100).alias(f"amount_sum_{h}") for h in ("1h", "24h")],
        (s.cast("double") / n / 100).alias("amount_mean_90d"),
        F.when(n > 1, F.sqrt(spread / (n * (n - 1))) / 100).alias("amount_std_90d"),
        (n / F.lit(90.0)).alias("typical_velocity_daily"))


def distinct_beneficiaries(tx: DataFrame) -> DataFrame:
    return rolling_distincts(tx, ACCOUNT, "beneficiary_id_hash", TS, {
        "distinct_beneficiaries_6h": 6 * HOUR, "distinct_beneficiaries_24h": DAY})


def distinct_devices(tx: DataFrame) -> DataFrame:
    return rolling_distinct(tx, ACCOUNT, "device_fingerprint_hash", TS, 30 * DAY, "distinct_devices_30d")


def failed_authentications(events: DataFrame, user: str, ts: str, failed: Column) -> DataFrame:
    """Failures in the last 7 days, one row per (user, instant)."""
    out = rolling_sums(events, user, ts, {"n": F.when(failed, 1).otherwise(0).cast("bigint")}, {"7d": 7 * DAY})
    return out.withColumnRenamed("n_7d", "failed_auth_count_7d")


def _marked(tx: DataFrame, found: DataFrame, keys: list[str], name: str, busy: DataFrame | None = None) -> DataFrame:
    """Adds whether the row is the one that `found` (keys, at, id; one row per key) names. Rows are
    compared, not ids: repeated ids stay apart, and rows without an id can be found too. Rows equal in key,
    instant and id are one transfer, and rows without a key are none."""
    rest = found.select(*keys, F.col("at").alias("_at"), F.col(ID).alias("_id"))
    joined = spread_join(tx, rest, keys, F.xxhash64(ID, TS), "left", heavy=busy)
    same = (F.unix_micros(TS) == F.col("_at")) & F.col(ID).eqNullSafe(F.col("_id"))
    return joined.withColumn(name, F.coalesce(same, F.lit(False))).drop("_at", "_id")


def first_transfers(tx: DataFrame) -> DataFrame:
    """account, beneficiary, at, id of the first transfer of each pair."""
    pair = [ACCOUNT, "beneficiary_id_hash"]
    whole = tx.where(F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull() & F.col(TS).isNotNull())
    first = F.min(F.struct(F.unix_micros(TS).alias("at"), F.col(ID).isNull().alias("none"), F.col(ID)))
    return whole.groupBy(*pair).agg(first.alias("f")).select(*pair, "f.at", F.col(f"f.{ID}").alias(ID))


def _lane(known: Column, *spread_on: str) -> Column:
    """Zero for rows that take part in a ranking; the others are spread over many tasks."""
    return F.when(known, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*spread_on), F.lit(4095))).cast("int")


def new_beneficiary(tx: DataFrame) -> DataFrame:
    """The first transfer of an account to a beneficiary. `tx` is read twice, once for the sizes of the pairs.

    The rows of ordinary pairs are shuffled once and ranked where they lie; the first transfers of pairs with
    very many rows are an aggregate joined back.
    """
    pair, name = [ACCOUNT, "beneficiary_id_hash"], "is_new_beneficiary"
    ordinary, heavy = parted(tx.drop(name), pair)
    known = F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull() & F.col(TS).isNotNull()
    order = Window.partitionBy(*pair, "_lane").orderBy(TS, F.col(ID).isNull(), ID)
    out = packed(ordinary, *pair).withColumn("_lane", _lane(known, ID, TS)).withColumn("_rank", F.rank().over(order))
    out = unpacked(out.withColumn(name, known & (F.col("_rank") == 1)).drop("_lane", "_rank"), tx, *pair)
    return out if heavy is None else out.unionByName(_marked(heavy, first_transfers(heavy), pair, name))


def dormant_account(tx: DataFrame, days: int = 90) -> DataFrame:
    """The first transfer of an account after a silence of `days`. `tx` is read twice, once for the sizes of
    the accounts.

    The rows of ordinary accounts are shuffled once and compared where they lie; for accounts with very many
    rows the transfers after a silence are found by tiles and joined back by account and instant.
    """
    name = "is_dormant_account"
    ordinary, heavy = parted(tx.drop(name), [ACCOUNT])
    known = F.col(ACCOUNT).isNotNull() & F.col(TS).isNotNull()
    earlier = Window.partitionBy(ACCOUNT, "_lane").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(ACCOUNT, "_lane", "_at").orderBy(F.col(ID).isNull(), ID)
    out = packed(ordinary, ACCOUNT).withColumns({"_lane": _lane(known, ID, TS), "_at": F.unix_micros(TS)}).withColumn(
        "_rank", F.rank().over(order)).withColumn("_silence", F.col("_at") - F.max("_at").over(earlier))
    follows = F.coalesce(F.col("_silence") > days * DAY * MICROS, F.lit(False))
    out = unpacked(out.withColumn(name, known & follows & (F.col("_rank") == 1)), tx, ACCOUNT).drop(
        "_lane", "_at", "_rank", "_silence")
    if heavy is None:
        return out
    found = after_gap(heavy, ACCOUNT, TS, ID, days * DAY).withColumn(TS, F.timestamp_micros("at").cast(tx.schema[TS].dataType))
    return out.unionByName(_marked(heavy, found, [ACCOUNT, TS], name))


def login_distance(tx: DataFrame, key: str, ts: str, lat: str, lon: str) -> DataFrame:
    """Great-circle distance to the place of the latest strictly earlier instant of the key.

    Several rows of one instant count as one place: the one with the largest coordinates. The rows of an
    ordinary key are shuffled once and compared where they lie; keys with very many rows go by tiles.
    """
    rows = tx.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts, lat, lon)
    ordinary, heavy = parted(rows, [key])

    def places(part):
        return part.groupBy(key, ts).agg(F.max(F.struct(lat, lon)).alias("p")).select(key, ts, f"p.{lat}", f"p.{lon}")

    before = F.lag(F.struct(lat, lon)).over(Window.partitionBy(key).orderBy(ts))
    found = places(packed(ordinary, key).repartition(key)).withColumn("_p", before).select(
        key, ts, lat, lon, F.col(f"_p.{lat}").alias(f"prev_{lat}"), F.col(f"_p.{lon}").alias(f"prev_{lon}"))
    found = unpacked(found, rows, key)
    if heavy is not None:
        far = previous_instant(places(heavy), key, ts, [lat, lon])
        found = found.unionByName(far.select(*found.columns))
    return found.select(key, ts, haversine_km(F.col(f"prev_{lat}"), F.col(f"prev_{lon}"),
                                              F.col(lat), F.col(lon)).alias("geo_distance_km"))


def behavioural_drift(tx: DataFrame, recent_days: int = 7, base_days: int = 90) -> DataFrame:
    """1 - exp(-KL) between the amount histogram of the last week and of the last 90 days.

    Buckets are powers of sixteen of the amount; every bucket gets one extra count, so the
    divergence is always defined. One row per (account, instant).
    """
    bucket = F.least(F.floor(F.log2(F.greatest("amount_inr", F.lit(1.0))) / 4), F.lit(DRIFT_BUCKETS - 1))
    measures = {f"b{i}": F.when(bucket == i, 1).otherwise(0).cast("bigint") for i in range(DRIFT_BUCKETS)}
    counts = rolling_sums(tx, ACCOUNT, TS, measures, {"recent": recent_days * DAY, "base": base_days * DAY})

    def share(i, side):
        total = sum((F.col(f"b{j}_{side}") for j in range(1, DRIFT_BUCKETS)), F.col(f"b0_{side}"))
        return (F.col(f"b{i}_{side}") + 1) / (total + DRIFT_BUCKETS).cast("double")

    kl = sum((share(i, "recent") * F.log(share(i, "recent") / share(i, "base")) for i in range(1, DRIFT_BUCKETS)),
             share(0, "recent") * F.log(share(0, "recent") / share(0, "base")))
    return counts.select(ACCOUNT, TS, (1 - F.exp(-kl)).alias("behavioural_drift_score"))


def peer_percentile(tx: DataFrame, group: str = "peer_group_id", tile_paise: int = 1_000_000) -> DataFrame:
    """Percent rank of each amount inside its peer group, 0 .. 100; one row per (group, amount).

    Equal amounts are counted together before anything is ranked.
    """
    levels = tx.where(F.col(group).isNotNull()).groupBy(group, paise().cast("bigint").alias("_paise")).agg(
        F.count(F.lit(1)).alias("n"))
    tile = F.expr(f"_paise div {tile_paise}")
    cum = running_totals(levels, [group], tile, ["_paise"], ["n"], whole=True)
    below = F.col("run_n") - F.col("n")
    return cum.select(group, "_paise", F.when(
        F.col("all_n") > 1, below * F.lit(100.0) / (F.col("all_n") - 1)).otherwise(0.0).alias("peer_amount_percentile"))


def shared_accounts(tx: DataFrame, entity: str, name: str) -> DataFrame:
    """Other accounts seen with the entity: distinct accounts minus one."""
    return tx.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        (F.count_distinct(ACCOUNT) - 1).cast("int").alias(name))


def with_shared_accounts(tx: DataFrame, entity: str, name: str) -> DataFrame:
    """Every row with the number of other accounts seen with its entity, NULL without an entity. `tx` is read
    twice, once for the sizes of the entities.

    The rows of ordinary entities are shuffled once and their accounts numbered where they lie; for entities
    with very many rows `shared_accounts` is joined back.
    """
    ordinary, heavy = parted(tx.drop(name), [entity])
    known, alone = F.col(entity).isNotNull(), Window.partitionBy(entity, "_lane")
    nth = F.when(F.col(ACCOUNT).isNotNull(), F.dense_rank().over(alone.orderBy(F.asc_nulls_last(ACCOUNT))))
    out = packed(ordinary, *dict.fromkeys([entity, ACCOUNT])).withColumn("_lane", _lane(known, ID, ACCOUNT)).withColumn("_nth", nth)
    out = out.withColumn(name, F.when(known, F.coalesce(F.max("_nth").over(alone), F.lit(0)) - 1).cast("int")).drop("_lane", "_nth")
    out = unpacked(out, tx, *dict.fromkeys([entity, ACCOUNT]))
    return out if heavy is None else out.unionByName(with_instants(heavy, shared_accounts(heavy, entity, name), [entity]))


def prior_reports(tx: DataFrame) -> DataFrame:
    """Confirmed fraud reports on the beneficiary before the instant, per (beneficiary, instant)."""
    confirmed = (F.col("label_source") == "CONFIRMED_SAR") & (F.col("label_is_fraud") == 1)
    key = "beneficiary_id_hash"
    rows = tx.where(F.col(key).isNotNull()).select(
        key, F.unix_micros(TS).alias("_at"), F.when(confirmed, 1).otherwise(0).cast("bigint").alias("n"))
    ordinary, heavy = by_size(rows, key)
    earlier = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    instants = [part.groupBy(key, "_at").agg(F.sum("n").alias("n")) for part in (ordinary, heavy) if part is not None]
    found = instants[0].select(key, "_at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if heavy is not None:
        cum = running_totals(instants[1].withColumn("_pos", 2 * F.col("_at")), [key], time_tile("_pos", TILE_SECONDS), ["_pos"], ["n"])
        found = found.unionByName(cum.select(key, "_at", (F.col("run_n") - F.col("n")).alias("before")))
    return unpacked(found, tx, key).select(key, F.timestamp_micros("_at").alias(TS), F.col("before").cast("int").alias("beneficiary_sar_count"))


def account_reports(tx: DataFrame) -> DataFrame:
    confirmed = (F.col("label_source") == "CONFIRMED_SAR") & (F.col("label_is_fraud") == 1)
    return tx.where(confirmed & F.col("beneficiary_id_hash").isNotNull()).groupBy(
        F.col("beneficiary_id_hash").alias("node_id")).agg(F.count(F.lit(1)).alias("sar"))


def undirected(tx: DataFrame) -> DataFrame:
    """Distinct neighbour pairs in both directions, without loops. A pair is shuffled once, smaller id first."""
    pairs = tx.select(F.least(ACCOUNT, "beneficiary_id_hash").alias("a"), F.greatest(ACCOUNT, "beneficiary_id_hash").alias("b")).where(
        F.col(ACCOUNT) != F.col("beneficiary_id_hash"))
    pairs = unpacked(packed(pairs, "a", "b").distinct(), pairs, "a", "b")
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.inline(both))


def directed(tx: DataFrame) -> DataFrame:
    """Distinct pairs of account (a) and beneficiary (b)."""
    pairs = tx.select(F.col(ACCOUNT).alias("a"), F.col("beneficiary_id_hash").alias("b"))
    return unpacked(packed(pairs, "a", "b").distinct(), pairs, "a", "b")


def second_hop_reports(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports two transfers away, counted along each path a - b - c with c not a.

    Adding up along paths is linear in the edges; listing the distinct accounts c would need
    every pair of neighbours of a hub. `pairs` is a stored table from `undirected`.
    """
    sar = reports.select(F.col("node_id").alias("b"), F.col("sar"))
    one = spread_join(pairs, sar, ["b"], F.col("a")).groupBy("a").agg(
        F.sum(F.coalesce("sar", F.lit(0))).alias("near"))
    steps = spread_join(pairs, one.select(F.col("a").alias("b"), "near"), ["b"], F.col("a"))
    total = steps.groupBy("a").agg(F.sum("near").alias("far"), F.count(F.lit(1)).alias("degree"))
    own = reports.select(F.col("node_id").alias("a"), F.col("sar").alias("own"))
    # each path a - b - a adds the account's own reports once per neighbour
    return total.join(own, "a", "left").select(
        F.col("a").alias("node_id"),
        (F.col("far") - F.col("degree") * F.coalesce("own", F.lit(0))).cast("bigint").alias("second_hop_sar_count"))


def rapid_fan_out(tx: DataFrame, window_seconds: int = 2 * HOUR, beneficiaries: int = 5) -> DataFrame:
    """Outgoing instants that belong to a dispersal, per (account, instant).

    A credit is dispersed when at least `beneficiaries` distinct accounts are paid within the
    window from it (both ends included); an outgoing instant is flagged when such a credit lies
    at most one window before it. Both steps are look-backs of fixed length, so credits and
    payments are never paired up. The payments and credits of an ordinary account are shuffled once
    and stay in that task; those of accounts with very many rows go by tiles.
    """
    rows = tx.where(F.col(TS).isNotNull()).select(F.inline(F.array(
        F.struct(F.col(ACCOUNT), F.unix_micros(TS).alias("_at"), F.col("beneficiary_id_hash").alias("_item"), F.lit(True).alias("_pays")),
        F.struct(F.col("beneficiary_id_hash").alias(ACCOUNT), F.unix_micros(TS).alias("_at"), F.lit(None).cast(
            tx.schema["beneficiary_id_hash"].dataType).alias("_item"), F.lit(False).alias("_pays")),
    ))).where(F.col(ACCOUNT).isNotNull())
    ordinary, heavy = by_size(rows, ACCOUNT, "_item")
    found = _fan_out_near(ordinary, window_seconds * MICROS, beneficiaries)
    if heavy is not None:
        found = found.unionByName(_fan_out_tiled(heavy, window_seconds, beneficiaries))
    return unpacked(found, tx, ACCOUNT).select(ACCOUNT, F.timestamp_micros("_at").alias(TS), "rapid_fan_out_flag")


def _fan_out_near(rows: DataFrame, width: int, beneficiaries: int) -> DataFrame:
    """account, _at and the flag of outgoing instants, of payments and credits that lie together by account.

    Positions are half microseconds: a payment counts from its instant to one window later, and the end of a
    credit's window asks for the count; then a dispersed credit counts in the same way, and payments ask."""
    at, pays, no = F.col("_at"), F.col("_pays"), F.lit(0).cast("bigint")
    seen, so_far = Window.partitionBy(ACCOUNT, "_item", "_pays").orderBy("_at"), Window.partitionBy(ACCOUNT).orderBy("_pos")
    known = pays & F.col("_item").isNotNull()

    def change(position, by=0, asks=False, goes=False):
        return F.struct(position.alias("pos"), (no + by).alias("step"), F.lit(asks).alias("asks"), F.lit(goes).alias("goes"))

    def counted(events, *changes):
        steps = events.select(ACCOUNT, F.explode(F.filter(F.array(*changes), lambda c: c.isNotNull())).alias("c"))
        sums = steps.groupBy(ACCOUNT, F.col("c.pos").alias("_pos")).agg(
            F.sum("c.step").alias("step"), F.max("c.asks").alias("_asks"), F.max("c.goes").alias("_goes"))
        return sums.withColumn("n", F.sum("step").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    marked = rows.distinct().withColumns({
        "_opens": known & F.coalesce(at - F.lag("_at").over(seen) > width, F.lit(True)),
        "_closes": known & F.coalesce(F.lead("_at").over(seen) - at > width, F.lit(True))})
    paid = counted(marked, F.when(pays, change(2 * at + 1, goes=True)), F.when(~pays, change(2 * (at + width) + 1, asks=True)),
                   F.when(F.col("_opens"), change(2 * at, 1)), F.when(F.col("_closes"), change(2 * (at + width) + 2, -1)))
    dispersed, end = F.col("_asks") & (F.col("n") >= beneficiaries), F.col("_pos") - 1
    hits = counted(paid.where("_asks or _goes"), F.when(F.col("_goes"), change(F.col("_pos"), goes=True)),
                   F.when(dispersed, change(end - 2 * width, 1)), F.when(dispersed, change(end + 2, -1)))
    return hits.where("_goes").select(ACCOUNT, F.expr("(_pos - 1) div 2").alias("_at"), (F.col("n") > 0).alias("rapid_fan_out_flag"))


def _fan_out_tiled(rows: DataFrame, window_seconds: int, beneficiaries: int) -> DataFrame:
    """The same for accounts of any size."""
    out = rows.where("_pays").select(ACCOUNT, F.timestamp_micros("_at").alias(TS), "_item")
    credits = rows.where("not _pays").select(ACCOUNT, F.timestamp_micros("_at").alias("credited")).distinct()
    horizon_end = F.timestamp_micros(F.unix_micros("credited") + window_seconds * MICROS)
    asked = credits.select(ACCOUNT, horizon_end.alias(TS), F.lit(None).cast(rows.schema["_item"].dataType).alias("_item"))
    paid = rolling_distinct(out.unionByName(asked), ACCOUNT, "_item", TS, window_seconds, "paid")
    start = F.timestamp_micros(F.unix_micros(TS) - window_seconds * MICROS)
    dispersed = paid.where(F.col("paid") >= beneficiaries).select(ACCOUNT, start.alias("credited")).join(
        credits, [ACCOUNT, "credited"])
    instants = out.select(ACCOUNT, TS).distinct().withColumn("hit", F.lit(0).cast("bigint"))
    events = dispersed.select(ACCOUNT, F.col("credited").alias(TS), F.lit(1).cast("bigint").alias("hit")).unionByName(instants)
    events = materialize(events, "dispersals")  # the sums read it several times
    hits = rolling_sums(events, ACCOUNT, TS, {"hit": F.col("hit")}, {"w": window_seconds})
    hits = hits.join(instants.select(ACCOUNT, TS), [ACCOUNT, TS], "left_semi")  # credits alone carry no outgoing payment
    return hits.select(ACCOUNT, F.unix_micros(TS).alias("_at"), (F.col("hit_w") > 0).alias("rapid_fan_out_flag"))


def pagerank(pairs: DataFrame, iterations: int = 5, damping: float = 0.85, store=lambda df, label: df,
             store_every: int = 3) -> DataFrame:
    """Fixed rounds of PageRank over distinct directed pairs (a, b), scaled by the maximum.

    Rank of nodes without outgoing pairs is spread evenly. `store` cuts the lineage every few
    rounds; pass a function that writes to shared storage. The rounds run on numbers in place of ids.
    """
    ids = store(distinct_ids(pairs, "a", "b"), "ids")
    seed = hash_seed(ids)
    pairs = store(shortened(pairs, seed, "a", "b"), "numbers")
    nodes = pairs.select(F.col("a").alias("node_id")).union(pairs.select("b")).distinct()
    degree = pairs.groupBy(F.col("a").alias("node_id")).agg(F.count(F.lit(1)).alias("out"))
    nodes = store(nodes.join(degree, "node_id", "left"), "nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    busy = store(heavy_keys(pairs, ["a"]), "busy")
    for step in range(1, iterations + 1):
        senders = ranks.where("out is not null").select(
            F.col("node_id").alias("a"), (F.col("rank") / F.col("out")).alias("give"))
        got = spread_join(pairs, senders, ["a"], F.col("b"), how="inner", heavy=busy).groupBy(
            F.col("b").alias("node_id")).agg(F.sum("give").alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        ranks = nodes.join(got, "node_id", "left").crossJoin(F.broadcast(lost)).select(  # one row
            "node_id", "out",
            (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if step % store_every == 0 and step < iterations:
            ranks = store(ranks, "ranks")
    top = F.broadcast(ranks.agg(F.max("rank").alias("top")))  # one row
    scaled = ranks.crossJoin(top).select("node_id", (F.col("rank") / F.col("top")).alias("originator_graph_centrality"))
    return restored(scaled, ids, seed, "node_id")


def usd_equivalent(tx: DataFrame, rates: DataFrame) -> DataFrame:
    """amount / rate valid at the transaction time; NULL before the first rate.

    Rates and rows are laid on one time line, cut into hours per currency: inside an hour the last
    rate so far is carried on, and an hour opens with the last rate of those before it. What a
    window holds is an hour of one currency, never its history.
    """
    hour = F.floor(F.unix_micros(TS) / (HOUR * MICROS))
    feed = rates.select("currency", F.col("rate_ts").alias(TS), F.col("rate").alias("_rate")).withColumn("_hour", hour)
    rows = tx.withColumn("_hour", hour)
    closing = feed.groupBy("currency", "_hour").agg(F.max_by("_rate", TS).alias("_closing"))
    hours = rows.select("currency", "_hour").where("_hour is not null").distinct().join(closing, ["currency", "_hour"], "full")
    earlier = Window.partitionBy("currency").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)  # one row an hour
    opening = hours.select("currency", "_hour", F.last("_closing", True).over(earlier).alias("_opening"))
    line = rows.withColumn("_is_row", F.lit(True)).unionByName(feed.withColumn("_is_row", F.lit(False)), allowMissingColumns=True)
    so_far = Window.partitionBy("currency", "_hour").orderBy(TS, "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    carried = line.withColumn("_now", F.last("_rate", True).over(so_far)).where("_is_row")
    found = carried.join(opening, ["currency", "_hour"], "left")
    return found.select(*[F.col(c) for c in tx.columns],
                        (F.col("amount_inr") / F.coalesce("_now", "_opening")).alias("amount_usd_equiv"))


def with_instants(tx: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Attach columns that depend on (key, instant) to every row of that instant."""
    names = [c for c in table.columns if c not in keys]
    return spread_join(tx.drop(*names), table, keys, F.col(ID))


def network_columns(tx: DataFrame, store=materialize) -> list[tuple[DataFrame, list[str]]]:
    """Tables (with their keys) of the columns that come from the transfer network: dispersal,
    reports two transfers away, centrality, and accounts that share the address."""
    pairs = store(undirected(tx), "pairs")
    far = second_hop_reports(pairs, store(account_reports(tx), "reports")).withColumnRenamed("node_id", ACCOUNT)
    arrows = store(directed(tx).where("a is not null and b is not null"), "directed")
    central = pagerank(arrows, store=store).withColumnRenamed("node_id", ACCOUNT)
    per_account = central.join(far.withColumn("second_hop_sar_count", F.col("second_hop_sar_count").cast("int")), ACCOUNT, "left")
    return [(store(rapid_fan_out(tx), "fan_out"), [ACCOUNT, TS]), (store(per_account, "centrality"), [ACCOUNT]),
            (store(shared_accounts(tx, "ip_node_id", "shared_ip_accounts"), "shared_ip"), ["ip_node_id"])]


def enrich(tx: DataFrame, store=materialize, network: bool = True, rates: DataFrame | None = None) -> DataFrame:
    """The behavioural columns of the contract, replacing those present.

    `tx` is a stored table; without `network` it is read once and need not be stored. Velocities, distinct counts, profile, drift, first and dormant flags,
    reports, peer rank and shared devices always; with `network` also dispersal, second-hop reports,
    centrality and shared addresses; with `rates` (currency, rate_ts, rate) also the amount in
    dollars. Failed logins and login distances come from login events, not from transactions: see
    `failed_authentications` and `login_distance`.

    Each join reads its left side twice, so the rows are stored after each of them, with `packed` ids; the
    tables that share the key (account, instant) are joined first. What the next step has read is deleted.
    """
    columns = tx.columns
    rows = with_graph_ids(tx) if network else tx
    ids = [c for c in (ACCOUNT, "beneficiary_id_hash", "device_fingerprint_hash", "ip_node_id") if c in rows.columns]
    kinds, rows = rows, store(packed(rows, *ids), "packed")

    def joined(*tables):
        parts = [store(t, "per-instant") for t in tables]
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, [ACCOUNT, TS])
        out = store(out, "per-instant")
        discard(*parts)
        return out

    tables = [(lambda: joined(velocities(rows), distinct_beneficiaries(rows), distinct_devices(rows)), [ACCOUNT, TS]),
              (lambda: store(prior_reports(rows), "reports"), ["beneficiary_id_hash", TS]),
              (lambda: store(peer_percentile(rows), "peers"), ["peer_group_id", "_paise"]),
              (lambda: store(shared_accounts(rows, "device_fingerprint_hash", "shared_device_accounts"), "shared"), ["device_fingerprint_hash"])]
    zero = ["shared_device_accounts"]
    if network:
        tables.append((lambda: store(behavioural_drift(rows), "drift"), [ACCOUNT, TS]))
        tables += [(lambda table=table: table, keys) for table, keys in network_columns(rows, store)]
        zero += ["shared_ip_accounts", "second_hop_sar_count"]
    out = store(new_beneficiary(rows), "enriched")
    out = _next(out, store(dormant_account(out).withColumn("_paise", paise().cast("bigint")), "enriched"))
    for make, keys in tables:
        table = make()
        out = _next(out, store(with_instants(out, table, keys), "enriched"), table)
    discard(rows)
    if rates is not None:
        out = _next(out, store(usd_equivalent(out.drop("amount_usd_equiv"), rates), "enriched"))
    return unpacked(out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}), kinds, *ids).select(*columns)


def _next(before: DataFrame, after: DataFrame, *read: DataFrame) -> DataFrame:
    discard(before, *read)
    return after
