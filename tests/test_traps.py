"""One small table per rule that is easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyrisk import schema
from tallyrisk.functions.scalars import half_even, quick_round, stable_int
from tallyrisk.operators import (contract, explain, features, graph, inject, metrics, positions, propagate,
                                 quality, skew, textdata, timeline)
from tallyrisk.sources import files, sample_view

T0 = dt.datetime(2024, 3, 1, 12, 0, 0)


def one(df):
    return df.collect()[0]


@pytest.fixture(scope="module")
def tx(spark, sf_dir):
    return sample_view.transactions(spark, sf_dir).cache()


def test_contract_has_48_columns_and_46_features():
    assert len(schema.TRANSACTION) == 48 and len(schema.FEATURES) == 46 and len(set(schema.FEATURES)) == 46
    assert len(schema.ACCOUNT_FEATURES) == 17
    assert "label_is_fraud" not in schema.raw_feature_columns() and "peer_group_id" not in schema.raw_feature_columns()


def test_stable_int_matches_known_merchant_ages(spark):
    row = one(spark.range(1).select(stable_int(F.lit("mcc_4829"), 3650).alias("n")))
    import hashlib
    assert row.n == int(hashlib.sha256(b"mcc_4829").hexdigest()[:8], 16) % 3650


def test_heavy_keys_share_buckets_with_others(spark, monkeypatch):
    monkeypatch.setattr(skew, "BUCKETS", 2)
    rows = spark.range(90).select(F.when(F.col("id") < 40, "a").when(F.col("id") < 70, "b").otherwise(F.col("id").cast("string")).alias("k"))
    assert {(r.k, r["_slices"]) for r in skew.heavy_keys(rows, ["k"], 10).collect()} == {("a", 4), ("b", 3)}


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_rows_of_an_ordinary_key_are_shuffled_once(spark):
    rows = spark.createDataFrame([("a", "x", T0), ("a", None, T0), (None, "x", T0)], "k string, i string, t timestamp")
    plan = timeline.rolling_distinct(rows, "k", "i", "t", 60, "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    assert [(r.k, r.n) for r in timeline.rolling_distinct(rows, "k", "i", "t", 60, "n").collect()] == [("a", 1)]


@pytest.mark.parametrize("limit", [100_000, 3])
def test_rolling_counts_do_not_depend_on_what_is_a_large_key(spark, monkeypatch, limit):
    monkeypatch.setattr(timeline, "KEY_ROWS", limit)
    data = [("a" if i % 3 else "b", None if i % 11 == 0 else f"i{i % 4}", T0 + dt.timedelta(seconds=(i * 37) % 600)) for i in range(40)]
    rows = spark.createDataFrame(data + [("c", "x", T0)], "k string, i string, t timestamp")
    back = dt.timedelta(seconds=90)
    near = lambda k, t: [d for d in data + [("c", "x", T0)] if d[0] == k and t - back <= d[2] <= t]
    got = {(r.k, r.t): r.n for r in timeline.rolling_distinct(rows, "k", "i", "t", 90, "n").collect()}
    assert got == {(k, t): len({d[1] for d in near(k, t)} - {None}) for k, _, t in data + [("c", "x", T0)]}
    sums = timeline.rolling_sums(rows, "k", "t", {"n": F.lit(1).cast("bigint")}, {"w": 90})
    assert {(r.k, r.t): r.n_w for r in sums.collect()} == {(k, t): len(near(k, t)) for k, _, t in data + [("c", "x", T0)]}


def test_half_even(spark):
    df = spark.createDataFrame([(0.0625,), (0.3125,), (0.4375,)], "p double")
    assert [r.x for r in df.select(half_even(F.col("p") * 8, 0).alias("x")).collect()] == [0.0, 2.0, 4.0]


def feature_row(spark, tx, **changes):
    base = tx.limit(1)
    kinds = {f.name: f.dataType for f in base.schema.fields}
    return one(features.transform(base.withColumns({k: F.lit(v).cast(kinds[k]) for k, v in changes.items()})))


def test_zero_replacement_only_for_zero(spark, tx):
    r = feature_row(spark, tx, amount_inr=150.0, amount_mean_90d=100.0, amount_std_90d=0.0, velocity_1h=0,
                    velocity_24h=0, amount_sum_1h=50.0, typical_velocity_daily=0.0)
    assert r.amount_zscore == 10.0 and r.velocity_ratio_1h_24h == 0.0
    assert abs(r.amount_per_tx_1h - 3.9318256) < 1e-6
    assert feature_row(spark, tx, amount_inr=100.2, amount_mean_90d=100.0, amount_std_90d=0.1).amount_zscore == pytest.approx(2.0)


def test_null_amount_stays_null_and_unknown_channel_sets_no_flag(spark, tx):
    r = feature_row(spark, tx, amount_inr=None, channel="ABC", ip_reputation_score=None, is_tor_vpn_proxy=None)
    assert r.amount_inr_log is None and r.ctr_proximity is None and r.amount_zscore is None
    assert [r[f"channel_{c}"] for c in schema.MODEL_CHANNELS] == [0.0] * 5
    assert r.ip_reputation_score == 0.5 and r.is_tor_vpn_proxy == 0.0


@pytest.mark.parametrize("amount,expected", [(0.0, 0.0), (999_999.0, 0.999999), (1e6, 1.0), (2e6, 0.0), (3e6, 0.0)])
def test_threshold_proximity(spark, tx, amount, expected):
    assert feature_row(spark, tx, amount_inr=amount).ctr_proximity == pytest.approx(expected)


def test_calendar(spark, tx):
    r = feature_row(spark, tx, transaction_dt=dt.datetime(2024, 3, 2, 5, 59))
    assert (r.is_weekend, r.is_nighttime, r.day_of_week, r.is_month_end) == (1.0, 1.0, 5.0, 0.0)
    r = feature_row(spark, tx, transaction_dt=dt.datetime(2024, 3, 28, 21, 59))
    assert (r.is_weekend, r.is_nighttime, r.is_month_end) == (0.0, 0.0, 1.0)


def test_missing_raw_column_is_an_error(tx):
    with pytest.raises(ValueError):
        features.transform(tx.drop("velocity_1h"))


def test_weights_average_one(tx):
    assert one(features.sample_weights(tx).agg(F.avg("sample_weight").alias("m"))).m == pytest.approx(1.0)


def test_quality_report_counts_planted_defects(spark, tx):
    bad = tx.withColumn("amount_inr", F.lit(0.0)).withColumn("watchlist_category", F.lit(None).cast("string"))
    report = quality.validate(bad.drop("currency"))
    n = tx.count()
    assert report.range_violations["amount_inr"] == n and report.schema_violations["currency"] == "required column missing"
    assert report.schema_violations["watchlist_category"].startswith(str(n)) and not report.passes_contract


def test_injection_dedupes_defaults_and_bounds(spark):
    rows = spark.createDataFrame([("t1", "a", 0.1, False), ("t2", "b", 0.9, False), ("t3", "c", None, True)],
                                 "transaction_id string, account_id_hash string, synthetic_identity_score double, rapid_fan_out_flag boolean")
    scores = spark.createDataFrame([("a", 0.1), ("a", 0.72), ("b", 0.0)], "account_id_hash string, gnn_fraud_probability double")
    out = {r.transaction_id: r for r in inject.inject_scores(rows, scores).collect()}
    assert out["t1"].mule_network_probability == 0.72 and out["t1"].rapid_fan_out_flag
    assert out["t2"].synthetic_identity_score == 0.9 and not out["t2"].rapid_fan_out_flag
    assert out["t3"].mule_network_probability == 0.0 and out["t3"].rapid_fan_out_flag and out["t3"].synthetic_identity_score is None
    with pytest.raises(ValueError):
        features.apply_graph_mode(rows, "other")


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src_node_id string, dst_node_id string")


@pytest.mark.parametrize("accounts,links", [(1, 0), (2, 1), (61, 59)])
def test_chain_length(spark, accounts, links):
    table = edges(spark, [(f"a{i:03d}", "d") for i in range(accounts)])
    assert graph.entity_chain(table, "R", 10_000, 60).count() == links


def test_whole_chain(spark):
    ids = [f"{i * 7919 % 1000:03d}" for i in range(500)]
    table = edges(spark, [(a, "d") for a in ids + ids[:50]] + [("x", "e"), ("y", "e"), ("z", "f")])
    got = {(r.shared_entity_id, r.src_node_id, r.dst_node_id) for r in graph.entity_chain(table, "R").collect()}
    ordered = sorted(set(ids))
    assert got == {("d", a, b) for a, b in zip(ordered, ordered[1:])} | {("e", "x", "y")}
    assert graph.shared_entity_edges(table, table, table).count() == 3 * len(got)


def test_shared_edges_caps(spark):
    table = edges(spark, [(f"a{i}", f"d{j}") for i in range(3) for j in range(3)])
    assert graph.shared_entity_edges(table, table, table, 0).count() == 0
    assert graph.shared_entity_edges(table, table, table, 2).count() == 2
    assert graph.shared_entity_edges(table, table, table, 6).count() == 6


def test_row_index_sets_the_address_slot(spark, tx):
    rows = tx.withColumn("row_index", F.lit(101)).limit(3)
    one_slot = tx.withColumn("row_index", F.lit(1)).limit(3)
    a = [r.ip_node_id for r in graph.with_graph_ids(rows, 100).collect()]
    b = [r.ip_node_id for r in graph.with_graph_ids(one_slot, 100).collect()]
    assert a == b  # 101 mod 100


def test_null_keys_and_modes(spark, tx):
    some = tx.limit(50).withColumn("merchant_category_code", F.lit(None).cast("string"))
    ids = graph.with_graph_ids(some, 50)
    assert graph.merchant_nodes(ids).count() == 0 and graph.merchant_edges(ids).count() > 0
    modes = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "s string").agg(F.mode("s", True).alias("m"))
    assert one(modes).m == "a"


def test_rolling_totals_are_the_same_with_and_without_tiles(spark, tx, monkeypatch):
    from tallyrisk.operators import timeline

    whole = sorted(contract.velocities(tx).collect(), key=str)
    monkeypatch.setattr(timeline, "KEY_ROWS", 5)
    assert sorted(contract.velocities(tx).collect(), key=str) == whole


def test_spread_join_slices_heavy_and_missing_keys(spark):
    left = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, "hot").when(F.col("id") < 900, F.lit(None)).otherwise(F.col("id").cast("string")))
    right = spark.createDataFrame([("hot", 1), ("950", 2)], "k string, v int")
    out = skew.spread_join(left, right, ["k"], F.col("id"), rows_per_task=50)
    assert out.count() == 1000 and out.where("v = 1").count() == 700 and out.where("v = 2").count() == 1
    assert skew.spread_join(left, right, ["k"], F.col("id"), how="inner", rows_per_task=50).count() == 701


def brute_rolling(rows, horizon):
    return {(k, t): sum(1 for k2, t2, _ in rows if k2 == k and t - horizon <= t2 <= t) for k, t, _ in rows}


@pytest.mark.parametrize("tile", [1, 7, 3600, 10**9])
def test_rolling_windows_match_brute_force(spark, tile):
    import random
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randrange(0, 400), rng.choice("xyz")) for _ in range(150)]
    df = spark.createDataFrame(rows, "k string, s int, item string").withColumn("ts", F.timestamp_seconds("s"))
    got = timeline.rolling_sums(df, "k", "ts", {"n": F.lit(1).cast("bigint")}, {"w": 30}, tile)
    assert {(r.k, int(r.s)): r.n_w for r in got.withColumn("s", F.unix_timestamp("ts")).collect()} == brute_rolling(rows, 30)
    distinct = timeline.rolling_distinct(df, "k", "item", "ts", 30, "d", tile)
    want = {(k, t): len({i for k2, t2, i in rows if k2 == k and t - 30 <= t2 <= t}) for k, t, _ in rows}
    assert {(r.k, int(r.s)): r.d for r in distinct.withColumn("s", F.unix_timestamp("ts")).collect()} == want


def test_silence_and_previous_instant(spark):
    rows = [("a", "1", 0), ("a", "2", 100), ("a", "3", 100), ("a", "4", 201), ("b", "5", 50)]
    df = spark.createDataFrame(rows, "k string, id string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.id for r in timeline.before_gap(df, "k", "ts", "id", 100).collect()} == {"4"}
    inst = df.groupBy("k", "ts").agg(F.max("s").alias("v"))
    prev = {(r.k, r.v): r.prev_v for r in timeline.previous_instant(inst, "k", "ts", ["v"], 60).collect()}
    assert prev == {("a", 0): None, ("a", 100): 0, ("a", 201): 100, ("b", 50): None}


def test_fan_out_on_dense_rows(spark):
    rows = [("src", "m", 0)] + [("m", f"b{i}", 600 * (i + 1)) for i in range(5)] + [("m", "late", 8000), ("q", "x", 10)]
    df = spark.createDataFrame(rows, "account_id_hash string, beneficiary_id_hash string, s int").withColumn(
        "transaction_dt", F.timestamp_seconds("s"))
    out = contract.rapid_fan_out(df).withColumn("s", F.unix_timestamp("transaction_dt")).collect()
    flagged = {(r.account_id_hash, int(r.s)) for r in out if r.rapid_fan_out_flag}
    assert {("m", 600 * (i + 1)) for i in range(5)} <= flagged and ("m", 8000) not in flagged and ("q", 10) not in flagged


def test_second_hop_counts_paths(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c")]
    both = spark.createDataFrame(pairs + [(y, x) for x, y in pairs], "a string, b string")
    reports = spark.createDataFrame([("c", 2), ("a", 1)], "node_id string, sar long")
    out = {r.node_id: r.second_hop_sar_count for r in contract.second_hop_reports(both, reports).collect()}
    assert out == {"a": 4, "b": 0, "c": 2, "d": 0}


@pytest.mark.parametrize("fetch", [1, 100_000])
def test_split_positions_with_ties(spark, fetch):
    df = spark.createDataFrame([(f"id{i:04d}", i // 50) for i in range(200)], "transaction_id string, s int").withColumn(
        "transaction_dt", F.timestamp_seconds("s"))
    out = positions.temporal_split(df, fetch=fetch)
    sizes = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 160, "val": 20, "test": 20}
    assert out.where("split = 'train'").agg(F.max("transaction_id")).first()[0] == "id0159"
    assert positions.split_sizes(100_000, 0.8, 0.1, 0.1) == (80_000, 90_000)
    with pytest.raises(ValueError):
        positions.split_sizes(10, 0.8, 0.1, 0.2)


def test_account_split_needs_twenty(spark):
    nodes = spark.range(20).select(F.col("id").cast("string").alias("node_id"), F.timestamp_seconds("id").alias("last_tx"))
    sizes = {r.split: r["count"] for r in positions.account_temporal_split(nodes).groupBy("split").count().collect()}
    assert sizes == {"train": 16, "val": 2, "test": 2}
    with pytest.raises(ValueError):
        positions.account_temporal_split(nodes.limit(19))


def scored(spark, rows):
    return spark.createDataFrame([(y, float(p), "t") for y, p in rows], "label int, probability double, split string")


def test_metrics_edge_cases(spark):
    r = one(metrics.rank_metrics(scored(spark, [(1, 0.2), (1, 0.9)]), ["split"]))
    assert (r.auc, r.pr_auc) == (0.0, 0.0)
    r = one(metrics.rank_metrics(scored(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]), ["split"]))
    assert r.auc == pytest.approx(0.75) and r.pr_auc == pytest.approx(0.8333333333)
    # 1.0 lies in no bin but counts; .3, .6, .7 sit one bin lower than floor(10 p) says
    assert one(metrics.calibration_error(scored(spark, [(0, 1.0), (1, 0.5)]), ["split"])).ece == pytest.approx(0.25)


def test_legacy_risk_truncates(spark):
    df = spark.createDataFrame([("a", 0.419), ("b", 0.409)], "transaction_id string, probability double")
    out = {r.transaction_id: (r.risk_score, r.is_fraud) for r in explain.legacy_response(df).collect()}
    assert out == {"a": (41, True), "b": (40, False)}


def test_contributions_all_zero_and_order(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id int, x double, y double, z double")
    zero = explain.describe_contributions(explain.linear_contributions(df, ["x", "y", "z"], [1, 1, 1], [0, 0, 0], ["id"]))
    assert {i.direction for i in one(zero).contributions} == {"neutral"}
    mixed = explain.linear_contributions(df, ["x", "y", "z"], [1, 2, 1], [1, 1, 1], ["id"])
    top = one(explain.rank_contributions(explain.describe_contributions(mixed)))
    assert [i.feature for i in top.top_contributors] == ["y", "x", "z"] and top.top_positive_contributors == []
    assert top.top_contributors[0].contribution_percentage == 50.0


def test_written_out_contributions_equal_the_general_form(spark):
    """Ties, zeros, missing numbers and a row without a reducing factor, with and without the names of the features."""
    names = ["x", "shared_device_accounts_log", "z", "mule_network_probability"]
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (2, 1.0, -1.0, 1.0, 5e-7), (3, 0.1234565, 2.5e-6, -7.7e9, 1e-7),
                                (4, None, 2.0, -3.0, 1.0), (5, float("nan"), 1.0, 2.0, 3.0)],
                               "id int, x double, shared_device_accounts_log double, z double, mule_network_probability double")
    rows = explain.linear_contributions(df, names, [1, 1, 1, 1], [0, 0, 0, 0], ["id"])
    for column in ("top_contributors", "top_positive_contributors", "top_negative_contributors", "graph_contributors"):
        found = [explain.long_form(explain.rank_contributions(explain.describe_contributions(rows, True, known), 3, names=known),
                                   column, ["id"]).orderBy("id", "rank").collect() for known in (None, names)]
        assert repr(found[0]) == repr(found[1]) and found[0]


def test_long_form_ranks_once(spark):
    """The lists are not worked out again in a filter for their size."""
    names = ["x", "y"]
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, x double, y double")
    rows = explain.describe_contributions(explain.linear_contributions(df, names, [1, 1], [0, 0], ["id"]), names=names)
    plan = explain.long_form(explain.rank_contributions(rows, names=names), "top_contributors", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1


def test_quick_round_is_exact(spark):
    values = [0.0, -0.0, 5e-7, 1.5e-6, 2.5e-6, -2.5e-6, 0.1234565, 0.1234575, -1e-9, 1e13, 7.7e9, float("nan"), float("inf"), None] + [
        (i * 7919 % 100003) / 9973 * (-1) ** i for i in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits, exact in ((6, F.bround), (2, F.bround), (1, F.round), (6, F.round)):
        out = df.select(quick_round(F.col("v"), digits, exact).alias("a"), exact("v", digits).alias("b")).collect()
        assert [repr(r.a) for r in out] == [repr(r.b) for r in out]


def test_wide_and_narrow_layers_agree(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", -1.0, 0.5), ("c", None, 1.0), ("d", float("nan"), 1.0)], "node_id string, x double, y double")
    weights, bias = [[1.0, 2.0], [0.5, -1.0]], [0.1, 0.2]
    narrow = propagate.dense(df, ["node_id"], ["x", "y"], weights, bias, "o").collect()
    monkeypatch.setattr(propagate, "WIDE", 0)
    wide = propagate.dense(df, ["node_id"], ["x", "y"], weights, bias, "o").collect()
    for a, b in zip(sorted(narrow), sorted(wide)):
        assert a[0] == b[0] and a[1:] == (pytest.approx(b[1:], nan_ok=True) if a[1] is not None else b[1:])
    assert [r[1] is None for r in sorted(wide)] == [False, False, True, False]


def test_scaling_of_constant_and_infinite_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", float("inf"), 5.0)], "node_id string, x double, y double")
    out = propagate.standardize(df, propagate.feature_statistics(df, ["x", "y", "w"]), ["x", "y", "w"])
    rows = {r.node_id: r for r in out.collect()}
    assert rows["a"].x == pytest.approx(1.0) and rows["b"].x == pytest.approx(-1.0) and rows["a"].y == 0.0 and rows["a"].w == 0.0


def test_record_shapes_and_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"messages":[{"role":"user","content":"q"}],"text":"t"}\n\n{"instruction":"i","input":"","output":"o"}\n')
    (tmp_path / "b.json").write_text('{"data":[{"text":"x"},{"other":1}]}')
    records = files.require_valid(files.read_records(spark, str(tmp_path)))
    out = textdata.normalize_instruction(records)
    shapes = sorted(r.shape or "none" for r in out.collect())
    assert shapes == ["instruction", "messages", "none", "text"] and textdata.rejected(out).count() == 1
    assert out.where("shape = 'instruction'").first().messages[0].content == "i"
    (tmp_path / "c.jsonl").write_text('{"broken": \n[1,2]\n')
    mixed = files.read_records(spark, str(tmp_path))
    assert mixed.where("not valid").count() == 2
    assert sorted(r.line for r in mixed.where("not valid").collect()) == [1, 2]
    with pytest.raises(ValueError, match="c.jsonl, line 1"):
        files.require_valid(mixed)
    with pytest.raises(FileNotFoundError):
        files.read_records(spark, str(tmp_path / "nothing"))


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    """Files that are read in many blocks, with blank and broken lines."""
    for name, n in (("a", 3000), ("b", 1), ("c", 700)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"text": "{name}{i + 1}"}}\n' if i % 7 else "\n" if i % 14 else "{broken\n" for i in range(n)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_jsonl(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(rows) == sum(1 for n in (3000, 1, 700) for i in range(n) if i % 7 or i % 14 == 0)
    for r in rows:
        assert (r.line - 1) % 14 == 0 and not r.valid if r.record == "{broken" else r.record == f'{{"text": "{r.file[-7]}{r.line}"}}'


def test_normalised_set_and_rejects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"t"}\n\nnope\n{"other":1}\n{"prompt":"p","completion":"c"}\n')
    base = str(tmp_path / "out")
    manifest = files.write_normalised(spark, str(tmp_path), base)
    assert manifest["counts"] == {"records": 2, "rejects": 2}
    rejects = files.read_latest(spark, base, "instruction_rejects").collect()
    assert sorted((r.line, r.record, r.reason) for r in rejects) == [(3, "nope", "no JSON object"), (4, '{"other":1}', "no known shape")]
    assert files.write_normalised(spark, str(tmp_path), base, "preference")["counts"] == {"records": 0, "rejects": 4}


def test_long_conversations_come_in_parts(spark):
    turns = spark.createDataFrame([(1, i, "user", str(i)) for i in range(10_001)] + [(2, 0, "user", "x")],
                                  "conv_id int, turn int, role string, text string")
    got = sorted((r.conv_id, r.part, len(r.messages), r.messages[0].content) for r in textdata.conversation_messages(turns).collect())
    assert got == [(1, 0, 10_000, "0"), (1, 1, 1, "10000"), (2, 0, 1, "x")]


def test_messages_keep_their_keys(spark):
    rows = spark.createDataFrame([('{"messages":[{"role":"tool","content":"c","tool_call_id":"7"}]}',)], "record string")
    assert '"tool_call_id":"7"' in one(textdata.normalize_instruction(rows)).messages_json


def test_records_in_memory(spark):
    df = files.records_table(spark, [{"transaction_id": "t", "amount_inr": 5, "transaction_dt": "2024-03-01T12:00:00Z", "zzz": 1}])
    row = one(df)
    assert row.amount_inr == 5.0 and "zzz" not in df.columns and dict(df.dtypes)["transaction_dt"] == "timestamp"


def test_keyed_scores_expire(spark):
    scores = spark.createDataFrame([("a", 0.5, 50)], "account_id_hash string, gnn_fraud_probability double, gnn_risk_score int")
    now = F.timestamp_seconds(F.lit(1000))
    rows = propagate.expiring_scores(scores, now, 10)
    assert one(rows).value == "0.500000"
    assert files.live_scores(rows, F.timestamp_seconds(F.lit(1009))).count() == 1
    assert files.live_scores(rows, F.timestamp_seconds(F.lit(1010))).count() == 0


def test_splits_with_nulls_and_equal_rows(spark):
    from datetime import datetime

    when = datetime(2024, 3, 1)
    rows = [(None if i % 9 == 0 else f"t{i % 7}", None if i % 5 == 0 else when, None if i % 6 == 0 else i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "transaction_id string, transaction_dt timestamp, label_is_fraud int")
    for marked in (positions.temporal_split(df, fetch=2), positions.stratified_split(df, fetch=2)):
        assert marked.count() == 100 and marked.where("split is null").count() == 0
    assert positions.temporal_split(df).where("transaction_dt is null and split = 'train'").count() == 0
    nodes = df.select(F.col("transaction_id").alias("node_id"), F.col("transaction_dt").alias("last_tx"))
    assert positions.cutoff_split(nodes.where("last_tx is not null")).where("split is null").count() == 0


def test_silences_of_rows_out_of_order(spark, tmp_path):
    from datetime import datetime, timedelta

    from tallyrisk import streaming

    start = datetime(2024, 3, 1)
    for n, hours in enumerate(([0, 20], [10, 21], [60])):
        rows = [("k", start + timedelta(hours=h), f"e{h}") for h in hours]
        spark.createDataFrame(rows, "k string, ts timestamp, id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.event_time(streaming.stream_table(spark, str(tmp_path / "in"), max_files=1), "ts", "30 hours")
    out = streaming.run_available(streaming.after_silence(stream, "k", "ts", "id", 9 * 3600), "silences")
    assert sorted((r.id, r.silence_seconds / 3600) for r in out.collect()) == [("e10", 10.0), ("e20", 10.0)]


def test_tables_lie_in_the_run_folder(spark):
    from tallyrisk import session

    stored = session.materialize(spark.range(3), "ids")
    assert stored.count() == 3 and session.run_folder(spark) in stored.inputFiles()[0].replace("file://", "").replace("file:", "")
