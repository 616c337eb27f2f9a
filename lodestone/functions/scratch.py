"""Tables in the scratch space that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size as the planner knows it (of columns in files) up to which the smaller side of a join goes to all tasks.
BROADCAST_BYTES = 16 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new folder path below spark.checkpoint.dir; where that is unset, as in tests, only a local session gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if root is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in shared scratch space: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def size_of(df: DataFrame) -> int:
    """Bytes of ``df``, a table in files or some of its columns, as the planner knows them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> DataFrame:
    """``df``, a table in files, marked for a broadcast where it is small, so that the other side of a join, texts as a rule, stays where it is."""
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES else df


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once all that was read from them is itself written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
