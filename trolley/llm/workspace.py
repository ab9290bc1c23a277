"""Shared tables between the jobs of one operator, and the workers' import path."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


#: Rows and bytes of a batch between Spark and a Python worker: Spark's default, and what stands in for it here.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


#: How the package's archive is called.
SHIPPED = "trolley-llm-"


def _package() -> str:
    """The package's modules as an archive that Spark sends to the executors; the driver's copy goes when the driver ends."""
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{SHIPPED}{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted((ROOT / "trolley").rglob("*.py")):
            archive.write(file, file.relative_to(ROOT))
    return path


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the Python workers, and bound what a batch of long texts holds."""
    for name, (default, ours) in BATCH.items():
        if spark.conf.get(name, ours) == default:
            spark.conf.set(name, ours)
    context = spark.sparkContext
    if not any(name.startswith(SHIPPED) for name in map(os.path.basename, context._python_includes)):
        context.addPyFile(_package())
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local session may go without that setting; it then gets a folder of its own under /tmp.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    os.makedirs(own)
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


class Workspace:
    """A fresh folder below the shared one that holds an operator's written tables and files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = prepare(spark)
        self.root, self.names = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back: its lineage ends here, and a lost executor costs a reread only.

        Its shuffles have served then; Spark deletes their files once the driver's JVM collects its garbage.
        """
        at = self.path(name)
        self.names.add(name)
        df.write.option("compression", "zstd").parquet(at)
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.names.discard(name)

    def clear(self, *keep: str) -> None:
        """Drop the tables that nothing reads any more: all but those to keep."""
        for name in self.names.difference(keep):
            self.drop(name)


#: Tells rows apart where doc_id does not.
ROW_KEY, _THEIRS = "_row_key", "_row_key_of_docs"


def keyed(docs: DataFrame, work: Workspace) -> DataFrame:
    """docs with a number of its own for each row, written once; a column of docs that has its name is set aside."""
    return work.table(docs.withColumnRenamed(ROW_KEY, _THEIRS).withColumn(ROW_KEY, F.monotonically_increasing_id()), "keyed")


#: Steps that give the same rows in the same tasks each time that they run.
_STEADY = {"FileScan", "Scan", "Project", "Filter", "ColumnarToRow", "AdaptiveSparkPlan", "WholeStageCodegen", "InputAdapter"}


def steady(docs: DataFrame) -> bool:
    """Whether docs only reads files: then a row has the same task and place in every pass, and a number made of these may be made anew."""
    run = docs._jdf.queryExecution()
    names = [re.sub(r"^[\s:+|*-]*(?:\*?\(\d+\))?\s*", "", line).split(" ")[0] for line in run.executedPlan().toString().splitlines() if line.strip() and not line.strip().startswith(("==", "+- =="))]
    return run.analyzed().deterministic() and all(n in _STEADY for n in names)


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that docs had before `keyed`."""
    return rows.select([F.col(f"`{_THEIRS if c == ROW_KEY else c}`").alias(c) for c in columns])


def by_key(rows: DataFrame) -> DataFrame:
    """Rows of `keyed` with their number in place of the doc_id."""
    return rows.withColumn("doc_id", F.col(ROW_KEY))


def partitions(spark: SparkSession) -> int:
    """Tasks of a wide step: the session's shuffle partitions, and at least two rounds of its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
