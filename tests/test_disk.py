"""What stays on the disks while a query runs: shuffles of finished jobs and stored tables that nothing reads any more go."""

import datetime
import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyrisk import session
from tallyrisk.operators import contract, graph, timeline, typed_graph

A, B, T, ID = "account_id_hash", "beneficiary_id_hash", "transaction_dt", "transaction_id"
START = datetime.datetime(2024, 1, 1)


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def transfers(spark, n=600, accounts=12):
    draw = random.Random(7)
    rows = [(f"t{i}", None if i % 41 == 0 else sha(draw.randrange(accounts)), None if i % 43 == 0 else sha(draw.randrange(accounts)),
             None if i % 53 == 0 else START + datetime.timedelta(minutes=draw.randrange(20_000))) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{ID} string, {A} string, {B} string, {T} timestamp")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + \
        df._jdf.queryExecution().executedPlan().toString().count("Exchange RoundRobin")


def test_finished_jobs_leave_no_shuffles_behind(spark):
    session.ship_package(spark)
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "true"
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert df.count() == df.count() == len(df.collect()) == len(df.collect()) == 7  # a plan may run again


def test_discarded_tables_are_gone_and_others_stay(spark):
    one, two = (session.materialize(spark.range(10), "numbers") for _ in range(2))
    session.discard(one, None, spark.range(3))
    assert not os.path.exists(one._stored_at.removeprefix("file:")) and two.count() == 10


@pytest.mark.parametrize("limit", [100_000, 20])
def test_fan_out_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(timeline, "KEY_ROWS", limit)
    data, tx = transfers(spark)
    width, least = datetime.timedelta(hours=30), 3
    paid = [(a, t, b) for _, a, b, t in data if a and t]
    credits = {(b, t) for _, _, b, t in data if b and t}
    dispersed = {(k, c) for k, c in credits if len({b for a, t, b in paid if a == k and b and c <= t <= c + width}) >= least}
    want = {(a, x): any(k == a and x - width <= c <= x for k, c in dispersed) for a, x, _ in paid}
    assert 0 < sum(want.values()) < len(want)
    got = contract.rapid_fan_out(tx, 30 * 3600, least).collect()
    assert {(r[A], r[T]): r.rapid_fan_out_flag for r in got} == want and len(got) == len(want)


def test_rolling_columns_shuffle_the_rows_once(spark):
    _, tx = transfers(spark)
    for made in (contract.rapid_fan_out(tx), contract.distinct_beneficiaries(tx), contract.velocities(tx.withColumn("amount_inr", F.lit(1.0))),
                 contract.prior_reports(tx.withColumns({"label_source": F.lit("CONFIRMED_SAR"), "label_is_fraud": F.lit(1)}))):
        assert exchanges(made) == 1


def test_edges_and_chains_shuffle_the_rows_once(spark):
    _, tx = transfers(spark)
    tx = tx.withColumns({"device_fingerprint_hash": F.col(B), "amount_inr": F.lit(1.0), "label_is_fraud": F.lit(0)})
    assert exchanges(graph.device_edges(tx)) == exchanges(graph.transfer_edges(tx)) == 1
    assert exchanges(graph.entity_chain(tx.select(F.col(A).alias("src_node_id"), F.col(B).alias("dst_node_id")), "R")) == 1


@pytest.mark.parametrize("limit", [100_000, 3])
def test_chains_follow_the_order_of_the_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(timeline, "KEY_ROWS", limit)
    ids = [sha(i) for i in range(6)] + ["", "a", "Z" * 31, "Z" * 40, sha(1).upper()]
    rows = [(a, e) for a in ids for e in ("x", sha("x"))]
    df = spark.createDataFrame(rows * 2, "src_node_id string, dst_node_id string")
    got = sorted((r[3], r[0], r[1]) for r in graph.entity_chain(df, "R").collect())
    order = sorted(ids)
    assert got == sorted((e, a, b) for e in ("x", sha("x")) for a, b in zip(order, order[1:]))


def test_typed_edges_store_a_relation_once(spark):
    kept = []
    nodes = {"account": spark.createDataFrame([(sha(1),), ("b",)], "node_id string")}
    edges = {"account__TRANSACTS_WITH__account": spark.createDataFrame([(sha(1), "b"), ("b", "gone")], "src_node_id string, dst_node_id string")}
    out = typed_graph.typed_edges(nodes, edges, store=lambda df, label: kept.append(df) or df)
    assert len(kept) == 1 and dict(kept[0].dtypes)["src_node_id"] == "binary"
    assert {(r.relation, r.src_node_id, r.dst_node_id) for r in out.collect()} == {
        ("TRANSACTS_WITH", sha(1), "b"), ("REV_TRANSACTS_WITH", "b", sha(1))}


def test_enriching_keeps_few_copies(spark, sf_dir):
    from tallyrisk.sources import sample_view

    tx = session.materialize(sample_view.transactions(spark, sf_dir).limit(300), "transactions")
    folder = session.run_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    out = contract.enrich(tx, network=False)
    assert out.columns == tx.columns and out.count() == 300
    left = sorted(os.path.basename(p).rsplit("-", 1)[0] for p in set(glob.glob(f"{folder}/*")) - before)
    assert left.count("enriched") == 1 and not {"packed", "per-instant", "reports", "peers", "shared"} & set(left)
