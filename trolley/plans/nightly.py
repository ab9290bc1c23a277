"""Tables that are derived once from the day's inputs and read by many queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from trolley.operators.shared import store

_WRITTEN: dict[tuple, tuple] = {}
_COUNTED: dict[tuple, int] = {}


def state(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> str:
    """A digest of the files of the tables, with their sizes and times of change."""
    jvm, conf, seen = spark._jvm, spark._jsc.hadoopConfiguration(), hashlib.sha256()
    for name in tables:
        at = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        for x in at.getFileSystem(conf).listStatus(at):
            seen.update(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}\n".encode())
    return seen.hexdigest()


def counted(spark: SparkSession, sf_dir: str, table: str) -> int:
    """The number of rows of a table, counted once for each state of its files."""
    key = (spark.sparkContext.applicationId, sf_dir, table, state(spark, sf_dir, (table,)))
    if key not in _COUNTED:
        _COUNTED[key] = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    return _COUNTED[key]


def nightly(*tables: str) -> Callable:
    """Write what build(spark, sf_dir, ...) gives once for each state of the tables that it reads, and read it back from then on.

    What is written lies below the shared folder, so a lost executor costs a reread; it is removed when the driver's JVM ends.
    """

    def wrap(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(build)
        def get(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
            key = (spark.sparkContext.applicationId, build.__name__, sf_dir, args, state(spark, sf_dir, tables))
            if key not in _WRITTEN:
                df = build(spark, sf_dir, *args)
                _WRITTEN[key] = store(df, build.__name__), df.schema
            path, schema = _WRITTEN[key]
            return spark.read.schema(schema).parquet(path)

        return get

    return wrap
