"""Session settings the operators are designed for."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000

#: Folders that a task writes at once; it sorts its rows by folder only above it.
OPEN_FOLDERS = 64
#: Bytes that each open folder gathers before it writes.
FOLDER_BUFFER = 8 << 20
#: The JVM never compiles a method of more bytes; Spark then splits the expressions of a stage into several.
COMPILED_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def local_session(cores: int = 8, app: str = "estatelens", memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites of columns are not recorded: building large plans takes half the time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Source files may be 1 MiB each, so batches to Python stay small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Where a local session names none, as in tests, it lies in the warehouse. A
    cluster has to name one: its warehouse may be a folder of one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/estatelens-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs started inside; put back afterwards."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def compile_methods(spark: SparkSession) -> None:
    """Lets Spark split long stages from now on, for plans that run after the call that builds them."""
    for name, value in COMPILED_METHODS.items():
        spark.conf.set(name, value)


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the scratch folder and read back.

    For results that several branches of a plan read: they are computed once,
    survive the loss of executors, and give later joins real sizes. With
    ``partition_by`` a task keeps a file open per folder: sorting whole rows by
    folder first, as Spark does otherwise, spills all of a large table.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    if not partition_by:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FOLDERS)}):
        df.write.partitionBy(*partition_by).option("parquet.block.size", str(FOLDER_BUFFER)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The small side of a join with file texts: broadcast only when its counted rows allow it.

    Rows hold an id, a hash or a path and flags, so a row bound is a size
    bound. Above it the join shuffles, and adaptive execution splits skew.
    """
    kept = stored(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the cluster when the source has fewer partitions than there are cores.

    Costs a shuffle only for inputs that small; a large table passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
