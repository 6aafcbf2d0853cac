"""Keyed rows with an expiry time: batches of upserts, newest row per key, compaction.

A batch is a folder of Parquet files and one commit. Reading takes the last compaction and the batches
after it and keeps the newest row of each key; expired rows are left out. A batch that is repeated
is known by its number and changes nothing, so a stream can hand over its micro-batches as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .commits import CommitLog


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "key", expires: str = "expires_at"):
        self.spark, self.path, self.key, self.expires = spark, path, key, expires
        self.log = CommitLog(spark, f"{path}/_commits")

    def _parts(self) -> tuple[str | None, int, list[tuple[int, str]]]:
        """Path of the last compaction, its highest batch, and (batch, path) of the batches it does not hold."""
        batches: dict[int, str] = {}
        for _, entry in self.log.newest_first():
            if entry["kind"] == "compaction":
                held = set(entry["later"])  # batches after the highest one in order that it holds too
                return entry["path"], entry["batch"], sorted((b, p) for b, p in batches.items() if b > entry["batch"] and b not in held)
            batches.setdefault(entry["batch"], entry["path"])
        return None, -1, sorted(batches.items())

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Add the rows of a batch; a later batch wins over an earlier one. False: the batch is there already.

        Of rows of one batch with one key the one that expires last counts, then the greatest."""
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        if self._has(batch):
            return False
        # a folder of its own for each attempt: one that failed halfway is named by no commit
        path = f"{self.path}/batches/{batch:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        if self._has(batch):
            return False
        self.log.append({"kind": "batch", "batch": batch, "path": path, "columns": rows.columns})
        return True

    def _has(self, batch: int) -> bool:
        _, highest, rest = self._parts()
        return batch <= highest or any(b == batch for b, _ in rest) or batch in self._later()

    def _later(self) -> set[int]:
        entry = self.log.latest(kind="compaction")
        return set(entry["later"]) if entry else set()

    def _newest(self) -> DataFrame | None:
        base, highest, rest = self._parts()
        parts = [] if base is None else [self.spark.read.parquet(base)]
        parts += [self.spark.read.parquet(p).withColumn("_batch", F.lit(b).cast("long")) for b, p in rest]
        if not parts:
            return None
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p, allowMissingColumns=True)
        others = [c for c in both.columns if c not in (self.key, self.expires, "_batch")]
        # partial maxima run before the shuffle, so a key that is written again and again stays cheap
        row = F.max(F.struct("_batch", self.expires, *others)).alias("r")
        return both.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(row).select(self.key, *[F.col(f"r.`{c}`").alias(c) for c in (self.expires, *others, "_batch")])

    def read(self, now: Column) -> DataFrame:
        """The newest row of every key, unless it has expired. An expired row does not bring an older one back."""
        rows = self._newest()
        if rows is None:
            raise FileNotFoundError(f"no batch in {self.path}")
        return rows.where(F.col(self.expires).isNull() | (F.col(self.expires) > now)).drop("_batch")

    def compact(self, now: Column) -> None:
        """Write the live rows as one table. Readers of older commits keep their files; `clean` removes them."""
        base, highest, rest = self._parts()
        done = sorted({b for b, _ in rest} | self._later())
        top = highest
        while top + 1 in done:
            top += 1
        rows = self._newest()
        if rows is None:
            return
        path = f"{self.path}/compacted/{uuid.uuid4().hex}"
        rows.where(F.col(self.expires).isNull() | (F.col(self.expires) > now)).write.parquet(path)
        self.log.append({"kind": "compaction", "batch": top, "later": [b for b in done if b > top], "path": path})

    def clean(self) -> int:
        """Delete batches and tables that the newest state does not name; call it when no reader is on them."""
        base, _, rest = self._parts()
        needed = {p.rstrip("/").rsplit("/", 1)[-1] for p in [*( [base] if base else []), *(p for _, p in rest)]}
        jvm, gone = self.spark._jvm, 0
        for folder in ("batches", "compacted"):
            top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if files.exists(top):
                for status in files.listStatus(top):
                    if status.getPath().getName() not in needed:
                        files.delete(status.getPath(), True)
                        gone += 1
        return gone
