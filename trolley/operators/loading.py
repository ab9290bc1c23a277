"""Loading landed files as transactions: gated rows go to two sinks under one batch number, and a log entry makes them count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators import gates

FEED = ["chain_id", "store_code"]
LOG = "sha256 string, chain_id string, store_code string, file_type string, file_ts timestamp_ntz, status string, reasons array<string>"
#: States of a file: what a load may decide. Waiting files are looked at again by the next load. Fixed values.
ACCEPTED, QUARANTINED, WAITING = "accepted", "quarantined", "waiting"


def states(files: DataFrame, log: DataFrame, stats: DataFrame) -> DataFrame:
    """The new files, one per content, with status and reasons.

    A delta without a full file of its feed that is as old or older, and that is loaded or comes with it, waits. Of the others,
    those with reasons go to quarantine. A full file in quarantine opens its feed to no delta. files: sha256, chain_id, store_code,
    file_type, file_ts. log: the same with status. stats: sha256, reasons.
    """
    final = log.where(F.col("status") != WAITING)
    fresh = gates.pending(files, final).drop("loadable").join(stats.select("sha256", "reasons"), "sha256", "left")
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    bad = F.size(reasons) > 0
    good = lambda rows, ok: rows.where((F.col("file_type") == "full") & ok).select(*FEED, "file_ts")
    fulls = good(final, F.col("status") == ACCEPTED).union(good(fresh, ~bad))
    first = fulls.groupBy(*FEED).agg(F.min("file_ts").alias("_full"))
    ready = (F.col("file_type") == "full") | F.coalesce(F.col("_full") <= F.col("file_ts"), F.lit(False))
    status = F.when(~ready, WAITING).when(bad, QUARANTINED).otherwise(ACCEPTED)
    return fresh.join(first, FEED, "left").select("sha256", *FEED, "file_type", "file_ts", status.alias("status"), reasons.alias("reasons"))


class Store:
    """A folder with accepted and quarantined rows by batch, and a log. A batch counts once its log entry is finished.

    A load that dies leaves rows that nothing reads, and the next one writes its own over them under the same number.
    One load runs at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the finished batches."""
        at = self._path(f"{self.root}/log")
        if not self._fs.exists(at):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch=") and self._fs.exists(self._path(f"{self.root}/log/{n}/_SUCCESS")))

    def log(self) -> DataFrame:
        """Each file with its latest state."""
        names = [(n, f"{self.root}/log/batch={n}") for n in self.batches()]
        if not names:
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG).option("basePath", f"{self.root}/log").parquet(*[p for _, p in names])
        each = rows.withColumn("batch", F.regexp_extract("_metadata.file_path", r"batch=([0-9]+)", 1).cast("long"))
        last = F.max_by(F.struct(*[x.split()[0] for x in LOG.split(", ")]), "batch")
        return each.groupBy("sha256").agg(last.alias("x")).select("x.*")

    def rows(self, status: str, schema) -> DataFrame:
        """The rows of a sink, of finished batches only, with their batch."""
        paths = [p for p in (f"{self.root}/{status}/batch={n}" for n in self.batches()) if self._fs.exists(self._path(p))]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
        read = self.spark.read.schema(schema).option("basePath", f"{self.root}/{status}").parquet(*paths)
        return read.withColumn("batch", F.regexp_extract("_metadata.file_path", r"batch=([0-9]+)", 1).cast("long"))

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{kind}/batch={batch}")

    def load(self, files: DataFrame, rows: DataFrame, stats: DataFrame) -> int | None:
        """Decide on the files and write their rows (sha256 and others); the number of the batch, or None if nothing is new.

        The decision is written first and read back, so both sinks and the log follow the same one.
        """
        batch = max(self.batches(), default=0) + 1
        self._write(states(files, self.log(), stats), "decided", batch)
        decided = self.spark.read.schema(LOG).parquet(f"{self.root}/decided/batch={batch}")
        old = self.log().where(F.col("status") == WAITING).select("sha256")
        news = decided.join(old.withColumn("_old", F.lit(True)), "sha256", "left").where((F.col("status") != WAITING) | F.col("_old").isNull())
        if not news.limit(1).count():
            return None
        for status in (ACCEPTED, QUARANTINED):
            self._write(rows.join(decided.where(F.col("status") == status).select("sha256"), "sha256", "left_semi"), status, batch)
        self._write(decided, "log", batch)
        return batch
