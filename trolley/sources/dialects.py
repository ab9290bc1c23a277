"""Price files of different chains: row tag, character set, container and column names by chain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.sources.splitter import split

#: Columns of the inner model, by the names of the first schema generation. Fixed values.
COLUMNS = {"ChainId": "chain_id", "StoreId": "store_code", "ItemCode": "item_code", "ItemName": "raw_name", "Quantity": "quantity", "UnitOfMeasure": "unit", "ManufacturerName": "manufacturer", "ItemPrice": "price", "PriceUpdateDate": "valid_from"}


@dataclass(frozen=True)
class Dialect:
    row_tag: str = "Item"
    charset: str = "UTF-8"
    container: str = "gzip"
    renamed: dict[str, str] = field(default_factory=dict)  # tag in the file: tag of the first generation


def adapt(rows: DataFrame, dialect: Dialect) -> DataFrame:
    """The inner model, whatever the file calls its columns; columns that the file lacks are null."""
    known = rows.withColumnsRenamed(dialect.renamed)
    return known.select(*[(F.col(tag) if tag in known.columns else F.lit(None).cast("string")).alias(name) for tag, name in COLUMNS.items()]).withColumns({"price": F.col("price").try_cast("decimal(12,2)"), "quantity": F.col("quantity").try_cast("decimal(12,3)"), "valid_from": F.col("valid_from").try_cast("timestamp_ntz")})


#: Columns that a file may state once for all its records.
ONCE = ["ChainId", "StoreId"]


def read(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame:
    """The rows of a chain's files in the inner model.

    Gzip, zip and plain files are told by their first bytes, and read as streams in any character set: a file is one task's
    work, as a gzip stream is anyway, and may be larger than the task's memory. What a record lacks of ONCE it has from its file.
    """
    tags = {tag: {v: k for k, v in dialect.renamed.items()}.get(tag, tag) for tag in COLUMNS}
    schema = T.StructType([T.StructField(own, T.StringType()) for own in tags.values()])
    found = split(spark, path, dialect.row_tag, dialect.charset, [tags[c] for c in ONCE])
    rows = found.select("fields", F.from_xml("record", schema).alias("r"))
    whole = rows.select(*[(F.coalesce(F.col("r")[own], F.col("fields")[own]) if tag in ONCE else F.col("r")[own]).alias(own) for tag, own in tags.items()])
    return adapt(whole, dialect)


def union(tables: list[DataFrame]) -> DataFrame:
    """Adapted tables of several chains and schema generations as one; a column that one lacks is null there."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def archive(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Add the bytes of landed files, untouched, to a table by content's hash, each content once whatever came before; the index (path, sha256, length) is returned.

    What the archive has stays as it is: a call adds the contents that it lacks, so a call that is repeated adds nothing.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")
    new = files.select("sha256", "content").dropDuplicates(["sha256"])
    at = spark._jvm.org.apache.hadoop.fs.Path(to)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.schema("sha256 string, content binary").parquet(to).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").parquet(to)
    return files.drop("content")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Files of a landing folder with their content's hash, for the load log."""
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"))
