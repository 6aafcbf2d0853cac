"""Steps of the graph that are taken for ordinary keys and for very large ones: both must agree."""

from __future__ import annotations

import glob
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import graph, propagate, short_ids, timeline
from tallyrisk.session import materialize


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def transfers(spark):
    """Accounts of 1 to 40 rows, devices shared by many, rows without an id, a device or a source."""
    n = spark.range(400).select(F.col("id").cast("int").alias("i"))
    return n.select(
        F.when(F.col("i") % 29 != 0, F.concat(F.lit("t"), "i")).alias("transaction_id"),
        F.when(F.col("i") % 31 != 0, F.concat(F.lit("a"), F.sqrt("i").cast("int"))).alias("account_id_hash"),
        F.concat(F.lit("a"), F.col("i") % 7).alias("beneficiary_id_hash"),
        F.when(F.col("i") % 5 != 0, F.concat(F.lit("d"), F.col("i") % 3)).alias("device_fingerprint_hash"),
        F.timestamp_seconds(F.col("i") * 7000).alias("transaction_dt"), (F.col("i") % 13).cast("double").alias("amount_inr"),
        (F.col("i") % 2).alias("label_is_fraud"), F.when(F.col("i") % 3 != 0, F.concat(F.lit("s"), F.col("i") % 4)).alias("label_source"),
        (F.col("i") % 11).alias("days_since_account_open"), (F.col("i") % 4).alias("beneficiary_sar_count"),
        (F.col("i") % 6).alias("second_hop_sar_count"), (F.col("i") % 8).cast("double").alias("typical_velocity_daily"),
        (F.col("i") % 9).cast("double").alias("amount_mean_90d"), (F.col("i") % 2 / 4).alias("ip_reputation_score"),
        (F.col("i") % 50 == 0).alias("watchlist_hit"), (F.col("i") % 4 / 4).alias("synthetic_identity_score"),
        (F.col("i") % 5).alias("distinct_devices_30d"), (F.col("i") % 3).alias("failed_auth_count_7d"))


def test_large_keys_take_the_other_way_to_the_same_rows(transfers, monkeypatch):
    def made():
        edges = graph.device_edges(transfers)
        roles = graph.account_roles(transfers)
        return [rows(edges), rows(roles), rows(graph.entity_chain(edges, "R"))]

    whole = made()
    assert len(whole[2]) == len({(r[0], r[3]) for r in whole[2]})  # each account is followed by one
    monkeypatch.setattr(timeline, "KEY_ROWS", 5)
    monkeypatch.setattr(graph, "KEY_ROWS", 5)
    assert made() == whole


def test_pairs_are_not_shuffled_once_more(transfers):
    edges = materialize(graph.device_edges(transfers), "edges")
    plan = graph.entity_chain(edges, "R", length=60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # distinct ends, then by entity


def test_seed_gives_each_id_its_number(spark, monkeypatch):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), (None, "a")], "x string, y string")
    ids = materialize(short_ids.distinct_ids(df, "x", "y"), "ids")
    seed = short_ids.hash_seed(ids)
    short = short_ids.shortened(df, seed, "x", "y")
    assert short.schema["x"].dataType.simpleString() == "bigint" and short.where("x is null").count() == 1
    assert rows(short_ids.restored(short, ids, seed, "x", "y").select("x", "y")) == rows(df)
    # where every seed gives two ids one number, the ids themselves are used
    monkeypatch.setattr(short_ids, "hashed", lambda name, s: F.col(name) if s is None else F.lit(1))
    assert short_ids.hash_seed(ids) is None
    assert rows(short_ids.shortened(df, None, "x", "y")) == rows(df)


def test_messages_carry_the_narrow_side(spark):
    vectors = spark.createDataFrame([(i, float(i), i / 3, -1.0 * i, 2.0) for i in range(6)], "node_id long, a double, b double, c double, d double")
    edges = spark.createDataFrame([(i, (i * i) % 5) for i in range(6)] + [(1, 1)], "src_node_id long, dst_node_id long")
    layer = {"w_self": [[1.0, -2.0, 0.5, 0.1]], "b_self": [0.25], "w_neigh": [[0.5, 1.0, -1.0, 3.0]], "b_neigh": [-0.5]}
    out = propagate.sage_layer(vectors, ["a", "b", "c", "d"], edges, layer, "h", activate=False)
    mean = {r.node_id: r for r in propagate.neighbour_mean(edges, vectors, ["a", "b", "c", "d"]).collect()}
    for r in out.collect():
        m = mean[r.node_id]
        want = m.a - 2 * m.b + 0.5 * m.c + 0.1 * m.d + 0.25 + 0.5 * m.n_a + m.n_b - m.n_c + 3 * m.n_d - 0.5
        assert r.h0 == pytest.approx(want)
    # once from the messages, not a mean for each of the four inputs
    assert out._jdf.queryExecution().optimizedPlan().toString().count("avg(") == 1


def test_stored_tables_are_written_in_zstandard(spark):
    df = materialize(spark.range(10), "small")
    path = urllib.parse.urlparse(df.inputFiles()[0]).path
    assert glob.glob(path) and ".zstd." in path
