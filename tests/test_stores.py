"""Committed versions, the keyed store, and streams over rows with missing values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyrisk import streaming
from tallyrisk.operators import contract
from tallyrisk.session import fresh_path
from tallyrisk.sources import files
from tallyrisk.sources.commits import CommitLog
from tallyrisk.sources.keyed_store import KeyedStore


def test_commits_are_numbered_and_whole(spark):
    path = fresh_path(spark, "log")
    log, other = CommitLog(spark, path), CommitLog(spark, path)
    assert log.latest() is None and log.numbers() == []
    assert [log.append({"a": 1}), other.append({"a": 2}), log.append({"a": 3, "text": "ü"})] == [1, 2, 3]
    assert other.latest() == {"a": 3, "text": "ü"} and other.latest(a=2) == {"a": 2}
    # a commit that is still being written is not seen
    half = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{4:012d}.json")
    stream = half.getFileSystem(spark._jsc.hadoopConfiguration()).create(half, False)
    stream.write(bytearray(b'{"a": 4'))
    stream.close()
    assert log.latest()["a"] == 3 and log.append({"a": 5}) == 5 and other.latest()["a"] == 5


def test_readers_keep_their_version(spark):
    base = fresh_path(spark, "versions")
    with pytest.raises(FileNotFoundError):
        files.read_latest(spark, base, "raw")
    files.write_version(spark.range(3), base, "raw", "r1")
    old = files.read_latest(spark, base, "raw")
    files.write_version(spark.range(5), base, "raw", "r2")
    assert (old.count(), files.read_latest(spark, base, "raw").count(), files.read_version(spark, base, "raw", "r1").count()) == (3, 5, 3)
    files.write_manifest(spark, base, "run", "r1", {"n": 1})
    files.write_manifest(spark, base, "run", "r2", {"n": 2})
    assert files.read_manifest(spark, base, "run")["n"] == 2 and files.read_manifest(spark, base, "run", "r1")["n"] == 1


def keyed(spark, rows):
    return spark.createDataFrame([(k, None if e is None else dt.datetime.fromtimestamp(e, dt.timezone.utc), v) for k, e, v in rows],
                                 "key string, expires_at timestamp, value string")


def held(store, now):
    return {r["key"]: r["value"] for r in store.read(F.timestamp_seconds(F.lit(now))).collect()}


def test_store_keeps_the_newest_row(spark):
    store = KeyedStore(spark, fresh_path(spark, "store"))
    with pytest.raises(FileNotFoundError):
        store.read(F.current_timestamp())
    assert store.upsert(keyed(spark, [("a", 100, "a0"), ("b", 100, "b0"), ("c", None, "c0"), (None, 900, "x")]), 0)
    assert store.upsert(keyed(spark, [("a", 50, "a2"), ("d", 300, "d2"), ("d", 200, "dx")]), 2)
    assert not store.upsert(keyed(spark, [("a", 900, "again")]), 2)
    assert store.upsert(keyed(spark, [("a", 500, "a1"), ("b", 500, "b1")]), 1)  # late: older than batch 2
    want = {"b": "b1", "c": "c0", "d": "d2"}
    assert held(store, 60) == want and held(store, 10) == {**want, "a": "a2"} and held(store, 400) == {"b": "b1", "c": "c0"}
    before = store.read(F.timestamp_seconds(F.lit(10)))
    store.compact(F.timestamp_seconds(F.lit(60)))  # a has expired
    assert held(store, 10) == want and before.count() == 4
    assert store.clean() == 3 and held(store, 10) == want
    assert not store.upsert(keyed(spark, [("b", 900, "again")]), 1)
    store.upsert(keyed(spark, [("b", 900, "b4")]), 4)
    store.compact(F.timestamp_seconds(F.lit(0)))  # batch 3 is still to come
    assert store.upsert(keyed(spark, [("b", 900, "b3"), ("e", 900, "e3")]), 3) and not store.upsert(keyed(spark, [("b", 900, "bx")]), 4)
    assert held(store, 60) == {**want, "b": "b4", "e": "e3"}


def test_store_of_a_failed_batch(spark):
    """Rows that were written but not committed do not count, and the batch can be handed over again."""
    path = fresh_path(spark, "store")
    keyed(spark, [("a", 900, "half")]).write.parquet(f"{path}/batches/000000000000-failed")
    store = KeyedStore(spark, path)
    assert store.upsert(keyed(spark, [("a", 900, "whole")]), 0) and held(store, 1) == {"a": "whole"}


def stream_of(spark, rows, shape):
    path = fresh_path(spark, "stream")
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(path)
    return streaming.event_time(streaming.stream_table(spark, path), "ts", "1 second")


T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def test_silences_with_missing_times_and_ids(spark):
    rows = [("u", 1, at(0)), ("u", None, at(100)), ("u", 3, at(100)), ("u", 4, None), (None, 5, at(50)), ("u", 6, at(500)), ("u", 7, at(9999))]
    out = streaming.after_silence(stream_of(spark, rows, "u string, id long, ts timestamp"), "u", "ts", "id", 60)
    got = {(r["id"], r["silence_seconds"]) for r in streaming.run_available(out, "silence").collect()}
    assert got == {(3, 100.0), (6, 400.0)}


def test_dispersal_with_missing_items_times_and_ties(spark):
    rows = [("u", 1, "in", at(0), None), ("u", 2, "out", at(10), "a"), ("u", 3, "out", at(10), None), ("u", 4, "out", at(10), "b"),
            ("u", 5, "out", None, "c"), ("u", None, "in", at(5), None), ("u", 7, "in", at(5), None), ("v", 8, "in", at(0), None),
            ("v", 9, "out", at(1), "a"), ("v", 10, "out", at(2), None), ("w", 99, "in", at(9999), None)]
    stream = stream_of(spark, rows, "u string, id long, kind string, ts timestamp, item string")
    out = streaming.dispersed_credits(stream, "u", "ts", F.col("kind") == "in", "id", "item", 60, 2)
    got = sorted((tuple(r) for r in streaming.run_available(out, "dispersal").collect()), key=repr)
    assert got == sorted([("u", 1, 2), ("u", None, 2), ("u", 7, 2)], key=repr)


def test_marks_stay_on_their_rows(spark):
    """Repeated ids and missing ids, keys and times: no row is lost or doubled."""
    rows = [("dup", "a", "x", at(0)), ("dup", "a", "x", at(5)), ("ok", "a", "y", at(0)), (None, "b", "x", at(1)), (None, "b", "x", at(2)),
            ("n", None, "x", at(0)), ("m", "a", None, at(0)), ("t", "c", "x", None), ("z", "a", "x", at(200 * 86400))]
    tx = spark.createDataFrame(rows, "transaction_id string, account_id_hash string, beneficiary_id_hash string, transaction_dt timestamp")
    key = lambda r: (r["transaction_id"], r["account_id_hash"], r["beneficiary_id_hash"], r["transaction_dt"])
    first = {key(r): r["is_new_beneficiary"] for r in contract.new_beneficiary(tx).collect()}
    assert len(first) == len(rows) and {k for k, v in first.items() if v} == {rows[0], rows[2], rows[3]}
    quiet = {key(r): r["is_dormant_account"] for r in contract.dormant_account(tx).collect()}
    assert len(quiet) == len(rows) and {k for k, v in quiet.items() if v} == {rows[8]}
