"""Ids as short bytes, and operators that shuffle the rows of ordinary keys once."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import contract, graph, timeline
from tallyrisk.operators.short_ids import packed, unpacked

A, B, T, ID = "account_id_hash", "beneficiary_id_hash", "transaction_dt", "transaction_id"


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def test_packed_ids_come_back(spark):
    texts = [None, "", "a", sha(1), sha(1).upper(), sha(2)[:63], sha(2) + "\n", "x" * 31, "x" * 32, "x" * 33, "é" * 16, "g" * 64, "x" * 31 + "\0"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, n int")
    short = packed(df, "t", "n")
    assert short.where(F.col("t").isNotNull()).select("t").distinct().count() == len(texts) - 1
    assert {r.n: r.t for r in unpacked(short, df, "t", "n").collect()} == dict(enumerate(texts))
    assert short.where(F.col("n") == texts.index(sha(1))).select(F.octet_length("t")).first()[0] == 32


def transfers(spark, n=4000):
    start = datetime.datetime(2024, 1, 1)
    rows = [(None if i % 41 == 0 else f"t{i % 3900}", None if i % 37 == 0 else sha(i % 60), None if i % 43 == 0 else sha(i * 7 % 50),
             None if i % 53 == 0 else start + datetime.timedelta(days=i * 31 % 700), "ip" if i % 3 else None) for i in range(n)]
    return spark.createDataFrame(rows, f"{ID} string, {A} string, {B} string, {T} timestamp, ip_node_id string")


MARKS = {"new": contract.new_beneficiary, "dormant": contract.dormant_account,
         "shared": lambda df: contract.with_shared_accounts(df, "ip_node_id", "n"),
         "distance": lambda df: contract.login_distance(df.select(A, T, F.length(B).cast("double").alias("x"), F.dayofmonth(T).cast("double").alias("y")), A, T, "x", "y")}


@pytest.mark.parametrize("name", MARKS)
def test_ordinary_and_heavy_keys_agree(spark, monkeypatch, name):
    """Every key ordinary, then keys above 3 rows (most of them) by the way of the heavy ones."""
    df = transfers(spark)
    near = sorted(map(str, MARKS[name](df).collect()))
    monkeypatch.setattr(timeline, "KEY_ROWS", 3)
    heavy = sorted(map(str, MARKS[name](df).collect()))
    assert near == heavy
    assert name == "distance" or len(near) == df.count()


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["new", "dormant", "shared", "distance"])
def test_rows_are_shuffled_once(spark, name):
    assert shuffles(MARKS[name](transfers(spark))) == 1


def test_edges_are_grouped_by_short_ids(spark):
    df = transfers(spark).withColumns({"amount_inr": F.lit(1.0), "label_is_fraud": F.lit(0)})
    for edges, other in ((graph.transfer_edges(df), B), (graph.ip_edges(df), "ip_node_id")):
        assert "unhex" in edges._jdf.queryExecution().executedPlan().toString()
        want = df.where(F.col(A).isNotNull() & F.col(other).isNotNull()).select(A, other).distinct()
        assert sorted(map(tuple, edges.select("src_node_id", "dst_node_id").collect())) == sorted(map(tuple, want.collect()))


def test_neighbour_pairs_both_ways(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", None), ("c", "a")], f"{A} string, {B} string")
    assert sorted(map(tuple, contract.undirected(df).collect())) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]
    assert shuffles(contract.undirected(df)) == 1
