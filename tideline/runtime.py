"""Session helpers: where intermediate tables live, and how far work is split."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one if all executors run in this
    process (tests); on a cluster an error, as no folder of one machine would do."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_tables: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: a cut lineage that survives lost executors,
    with a file size that lets the planner decide on a broadcast by measured bytes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Removes the tables that operators have written so far and gives their number. DataFrames that operators returned read
    from these tables, so call this once their results are stored."""
    removed = 0
    while _tables:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        removed += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return removed


def slots(spark: SparkSession) -> int:
    """Partitions that a wide stage gets by default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def groups_for(spark: SparkSession, rows: int, per_group: int) -> int:
    """Number of Python groups so that one holds about ``per_group`` rows and every slot gets work."""
    return max(slots(spark), math.ceil(rows / per_group))


def spread_groups(spark: SparkSession, rows: int, per_group: int) -> int:
    """Groups for ``repartitionById``, one to a task: about ``per_group`` rows each, and no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / per_group))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
