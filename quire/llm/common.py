"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose id is null sort after every other id and never count as earlier.
NULL_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (tests), a temporary
    folder is taken and kept in the session's settings, so that one session uses
    one folder; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = spark.conf.get("quire.shared.dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("quire.shared.dir", found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """All intermediate tables of an application lie in one folder."""
    return f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}"


def clear_stored(spark: SparkSession) -> None:
    """Delete the application's intermediate tables and token files; call it when the results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{uuid.uuid4().hex}/{name}"


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return docs.agg(F.sum(F.octet_length(col)).alias("n")).first()["n"] or 0


def parts_for(spark: SparkSession, n_bytes: int, per_part: int) -> int:
    """Partitions for so many bytes: at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / per_part))


def row_id(col: str = "doc_id") -> Column:
    """The id as a non-null long, null last."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def row_hash(col: str = "text") -> Column:
    """Tells rows apart that share an id; rows equal in both get equal results."""
    return F.xxhash64(F.col(col))


def unused(df: DataFrame, base: str) -> str:
    """A column name that the table does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without_rows(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table without the rows that ``rows`` (doc_id, h: ``row_id`` and ``row_hash``) names; all columns stay."""
    a, b = unused(docs, "_id"), unused(docs, "_h")
    named = rows.select(F.col("doc_id").alias(a), F.col("h").alias(b)).distinct()
    same = (row_id(id_col) == F.col(a)) & (row_hash(text_col) == F.col(b))
    return docs.join(named, same, "left_anti")
