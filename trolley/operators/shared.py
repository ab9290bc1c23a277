"""The folder that driver and executors share, and tables written there between the steps of an operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The folder that holds this package, and how its archive is called.
ROOT, SHIPPED = Path(__file__).resolve().parents[2], "trolley-"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors, once a context: functions that run there import them."""
    context = spark.sparkContext
    if not any(os.path.basename(x).startswith(SHIPPED) for x in context._python_includes):
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"{folder}/{SHIPPED}{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted((ROOT / "trolley").rglob("*.py")):
                archive.write(file, file.relative_to(ROOT))
        context.addPyFile(path)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it has a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/trolley-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def store(df: DataFrame, name: str) -> str:
    """Write df below the shared folder and give its path; it is removed when the driver's JVM ends."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: what follows does not work it out again, and a lost executor costs a reread."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))


PART = "_part"


def ranged(rows: DataFrame, order: list[Column], name: str = "ranged") -> DataFrame:
    """rows with the number of the task-sized range of the order that each lies in: a key of any size is spread over ranges."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return written(rows.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), name)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place, from 1, in a total order, without one task for all: places within ranges, and each range's start."""
    parts = ranged(rows, order)
    sizes = parts.groupBy(PART).agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = sizes.select(PART, before.alias("_before"))
    local = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    return parts.join(F.broadcast(start), PART).withColumn(name, (F.col("_before") + local).cast("long")).drop(PART, "_before")
