"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyrisk")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


# HotSpot leaves methods above this many bytes of bytecode uncompiled: wide projections (the 46 features) are
# then interpreted. Below it Spark splits them into small methods.
COMPILED_METHOD = "8000"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
# A stored table no longer needs the shuffles it was made by. Spark keeps them until the driver's garbage is collected,
# and the disks hold those of all stages at once, unless it is told to delete them when a job is over.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once. Workers that find it on their own
    path do not need it. The session keeps generated methods small, unless it names a limit itself, and
    deletes the shuffles of finished jobs."""
    if spark.conf.get(METHOD_LIMIT) == "65535":  # Spark's default
        spark.conf.set(METHOD_LIMIT, COMPILED_METHOD)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    context = spark.sparkContext
    if getattr(context, "_tallyrisk_sent", None) == context.applicationId:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tallyrisk-"), "tallyrisk.zip")  # read by the driver's file server
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._tallyrisk_sent = context.applicationId


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one named in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyrisk-"))
    return context.getCheckpointDir().rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_folder(spark)}/tallyrisk/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the run's folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete the run's intermediate tables, at the end of a run: results that were not written
    elsewhere read them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage and survives the loss of executors, because the files do not
    live on them. Zstandard, because ids in hex take half the room in it.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*stored: DataFrame | None) -> None:
    """Delete tables of `materialize` that nothing reads any more; other tables are left alone."""
    for df in stored:
        at = getattr(df, "_stored_at", None)
        if at is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
