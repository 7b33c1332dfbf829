"""Session helpers: settings every query relies on, and fault-tolerant lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings every query relies on.

    All times are UTC. Constraint propagation is off: it derives a predicate for every combination of the many derived
    columns of a detector (planning took 13 s for one of them), while no query here gains a pushed filter from it.
    Shuffle files go when the job that made them has ended: queries go on from written tables (see `cut`).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is configured and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="paysift-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


_PASSING: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The tables that are cut inside are deleted at the end: whatever is made of them must be written by then."""
    made: list[str] = []
    _PASSING.append(made)
    try:
        yield
    finally:
        _PASSING.remove(made)
        for x in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the table to the checkpoint folder and continue from there.

    A written table survives the loss of executors, ends the lineage, and has a known size for later join planning.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    for made in _PASSING[-1:]:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task sorts without spilling, also on small executors.
ROWS_A_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks `rows` rows need beyond the configured number of shuffle partitions; 0 if that number is enough."""
    n = -(-rows // ROWS_A_TASK)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The table dealt by its keys, over as many tasks as `rows` rows need."""
    n = tasks_for(df.sparkSession, rows)
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paysift")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
