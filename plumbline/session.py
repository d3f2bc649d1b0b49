"""Session settings, table reading and lineage cuts that every operator shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``; any file system that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer pieces than there are cores, dealt out anew; larger ones pass as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, *keys: str, rows: int = 0, per_task: int = 100_000) -> DataFrame:
    """``df`` shuffled by ``keys`` into as many partitions as shuffles have, which adaptive execution does not join.

    With the number of its ``rows`` in more partitions where tasks would get more than ``per_task`` each.

    For rows that cost far more time than their bytes tell; joins and windows on these keys need no further shuffle.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-rows // per_task))
    return df.repartition(n, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: ``spark.checkpoint.dir`` of the session.

    Only where a session has none (local tests) a temporary folder is set, and only a local master gets one.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="plumbline-")
    context.setCheckpointDir(path)
    return context.getCheckpointDir()


def few(df: DataFrame, rows: int, per_task: int = 250_000) -> DataFrame:
    """``df`` in at most one task for every ``per_task`` of its ``rows``, so that little work is not dealt out as dust.

    A table that fits one task needs no shuffle at all in what follows; a large one keeps its partitions.
    """
    out = df.coalesce(max(1, -(-rows // per_task)))
    if "_staged_path" in df.__dict__:
        out._staged_path = df._staged_path
    return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a compressed Parquet table that :func:`release` deletes as soon as nothing needs it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder among the lineage cuts, for tables with a layout of their own; it goes at the end of the process."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def release(*tables: DataFrame) -> None:
    """Deletes staged tables of which everything has been computed and cut."""
    for table in tables:
        path = table.__dict__.pop("_staged_path", None)
        if path:
            _remove(table.sparkSession, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort at the end of the process; the session may be gone by then."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - nothing is left to clean up with
        pass


def python_ready(spark: SparkSession, rows: int = 512, batch_bytes: int = 8 << 20) -> None:
    """For operators with Python: workers find this package, and get Arrow batches of bounded rows and bytes.

    Bounded batches keep very long texts within a worker's memory.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", batch_bytes)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
