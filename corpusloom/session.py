"""Session settings, table loading and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_ROOTS: dict[str, str] = {}
_RECORDERS: list[list[str]] = []


def local_session(cores: int = 8, app: str = "corpusloom") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the cluster's own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.default.parallelism", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session.

    A session in one JVM that names none gets a folder of its own, once; a cluster must name one, as a
    folder of the driver's machine is out of its executors' sight.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if master not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[master] = tempfile.mkdtemp(prefix="corpusloom-ckpt-")
    return _LOCAL_ROOTS[master]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Used where a frame is read several times or where an iteration must not grow its lineage.
    The copy lives on shared storage, so a lost executor costs a re-read and not a re-run.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), f"loom-{uuid.uuid4().hex}")
    for made in _RECORDERS:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded_copies() -> Iterator[list[str]]:
    """Collect the paths that :func:`materialize` writes meanwhile, for :func:`drop_copies` later."""
    made: list[str] = []
    _RECORDERS.append(made)
    try:
        yield made
    finally:
        _RECORDERS.remove(made)


def drop_copies(spark: SparkSession, paths: list[str]) -> None:
    """Delete copies that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when a frame has fewer partitions than the cluster has slots.

    A small input in one file would otherwise run narrow, CPU-heavy steps in a single task. Inputs
    that already have enough partitions pass through without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


def dealt(df: DataFrame, key: str, rows: int = 200_000) -> DataFrame:
    """``df`` dealt out by ``key`` when its partitions are fewer than the slots or hold more than ``rows`` rows each.

    For narrow tables of many rows that sit in few files and are multiplied by the next step. Parquet counts its
    rows without reading them; the rows dealt to a task stay as many however large the table is.
    """
    parts = df.rdd.getNumPartitions()
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(wanted, key) if parts < wanted else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def load_numbered(spark: SparkSession, sf_dir: str, table: str, out: str = "row") -> DataFrame:
    """A table with a number per row that is the same at every read: its file's place among the files, its place in the file."""
    df = load(spark, sf_dir, table)
    paths = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())
    files = F.broadcast(spark.createDataFrame(list(enumerate(paths)), "_file long, _path string"))
    placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at")).join(files, "_path")
    return placed.select(*df.columns, (F.shiftleft("_file", 40) + F.col("_at")).alias(out))
