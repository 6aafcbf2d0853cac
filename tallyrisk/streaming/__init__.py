"""Streaming forms of the behavioural columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import fresh_path


def stream_table(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet, or one file of it, as a stream with the schema of the files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if path.endswith(".parquet"):
        # a stream watches folders: name the file by a filter
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def window_velocity(stream: DataFrame, key: str, ts: str, amount: str, item: str, size: str, slide: str) -> DataFrame:
    """Count, sum and approximate distinct items per key and sliding window. Partial sums run
    before the shuffle, so a busy key stays cheap."""
    return stream.groupBy(F.window(ts, size, slide).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"),
        F.approx_count_distinct(item).alias("distinct_items")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total", "distinct_items")


def first_pairs(stream: DataFrame, key: str, item: str) -> DataFrame:
    """First row of each (key, item) while the pair stays inside the watermark."""
    return stream.dropDuplicatesWithinWatermark([key, item])


def _plain(value):
    """A number or text that JSON can hold; missing values of a Pandas column are None."""
    return None if pd.isna(value) else value.item() if hasattr(value, "item") else value


def _by_time(row: list) -> tuple:
    """Order of [time, id] rows, also where an id is missing."""
    return row[0], row[1] is None, "" if row[1] is None else row[1]


def after_silence(stream: DataFrame, key: str, ts: str, row_id: str, gap_seconds: int) -> DataFrame:
    """Rows that follow a silence longer than the gap, in event-time order whatever the order of
    arrival. `stream` carries a watermark: rows wait in the state of their key until it has passed
    them, then the gaps are taken in order. The state is the time of the last row and the rows that
    still wait. Rows without a time or a key follow nothing and are left out; rows of one instant are
    taken by id, those without an id last."""
    id_type = stream.schema[row_id].dataType
    out = T.StructType([T.StructField(row_id, id_type), T.StructField("silence_seconds", T.DoubleType())])
    state_type = T.StructType([T.StructField("last", T.LongType()), T.StructField("waiting", T.StringType())])

    def update(_key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (state.get[0], json.loads(state.get[1])) if state.exists else (None, [])
        if not state.hasTimedOut:
            for batch in batches:
                waiting += [[int(at), _plain(i)] for at, i in zip(batch["_at"], batch[row_id])]
        passed = state.getCurrentWatermarkMs()
        waiting.sort(key=_by_time)
        ready = [w for w in waiting if w[0] // 1000 < passed]
        waiting = waiting[len(ready):]
        ids, gaps = [], []
        for at, i in ready:
            if last is not None and at - last > gap_seconds * 1_000_000:
                ids.append(i)
                gaps.append((at - last) / 1e6)
            last = at if last is None else max(last, at)
        state.update((last, json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, passed + 1))
        yield pd.DataFrame({row_id: ids, "silence_seconds": gaps})

    rows = stream.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(key, row_id, ts, F.unix_micros(ts).alias("_at"))
    return rows.groupBy(key).applyInPandasWithState(update, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def dispersed_credits(stream: DataFrame, key: str, ts: str, credit: Column, row_id: str, item: str,
                      window_seconds: int, at_least: int) -> DataFrame:
    """Credits that are followed by enough distinct items within the window (both ends included).

    `stream` carries a watermark; rows where `credit` holds are credits, all others payments. A credit
    is judged once the watermark has passed its window. Credits and payments are not paired up: for
    the credits of a key, in order, two pointers move over its payments and keep a count per item.
    The state holds the credits that still wait and the payments they may need. Rows without a time or a key
    are left out, and so are payments without an item: they are no distinct item."""
    types = {f.name: f.dataType for f in stream.schema.fields}
    out = T.StructType([T.StructField(key, types[key]), T.StructField("credit_id", types[row_id]), T.StructField("items", T.LongType())])
    state_type = T.StructType([T.StructField("credits", T.StringType()), T.StructField("payments", T.StringType())])
    span = window_seconds * 1_000_000

    def update(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        credits, payments = (json.loads(x) for x in state.get) if state.exists else ([], [])
        if not state.hasTimedOut:
            for batch in batches:
                for at, i, what, is_credit in zip(batch["_at"], batch[row_id], batch[item], batch["_credit"]):
                    (credits if is_credit else payments).append([int(at), _plain(i) if is_credit else what])
        passed = state.getCurrentWatermarkMs()
        credits.sort(key=_by_time)
        payments.sort(key=lambda p: p[0])
        ready = [c for c in credits if (c[0] + span) // 1000 < passed]
        found, held, low, high = [], {}, 0, 0
        for at, i in ready:
            while high < len(payments) and payments[high][0] <= at + span:
                held[payments[high][1]] = held.get(payments[high][1], 0) + 1
                high += 1
            while low < high and payments[low][0] < at:
                held[payments[low][1]] -= 1
                if not held[payments[low][1]]:
                    del held[payments[low][1]]
                low += 1
            if len(held) >= at_least:
                found.append((group[0], i, len(held)))
        credits = credits[len(ready):]
        # a credit still to come is no older than the watermark
        needed = min([c[0] for c in credits[:1]] + [passed * 1000])
        state.update((json.dumps(credits), json.dumps([p for p in payments if p[0] >= needed])))
        if credits:
            state.setTimeoutTimestamp(max((credits[0][0] + span) // 1000 + 1, passed + 1))
        yield pd.DataFrame(found, columns=[key, "credit_id", "items"])

    is_credit = F.coalesce(credit, F.lit(False))
    known = stream.where(F.col(ts).isNotNull() & F.col(key).isNotNull() & (is_credit | F.col(item).isNotNull()))
    rows = known.select(key, row_id, item, ts, F.unix_micros(ts).alias("_at"), is_credit.alias("_credit"))
    return rows.groupBy(key).applyInPandasWithState(update, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything that is there, write Parquet to the shared folder, read it back."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    query = (stream.writeStream.format("parquet").option("path", f"{path}/data")
             .option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], label: str) -> str:
    """Score each micro-batch with a batch function; a batch that is retried overwrites itself."""
    path = fresh_path(stream.sparkSession, label)

    def handle(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return f"{path}/data"


def closed_windows(result: DataFrame, newest: Column) -> DataFrame:
    return result.where(F.col("window_end") <= newest)
