"""File sources: catalogues of document files and decoded images."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.scalars import base_name


def catalog_scan(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, name, file_size, is_loading, page_count of a folder's files, by default the ``.pdf`` ones; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", base_name(F.col("path")).alias("name"), F.col("length").alias("file_size"), F.lit(False).alias("is_loading"), F.lit(0).alias("page_count"))


def image_scan(spark: SparkSession, folder: str) -> DataFrame:
    """origin, width, height, decoded, data: images that can't be decoded are kept and marked."""
    rows = spark.read.format("image").load(folder).select("image.*")
    return rows.select("origin", "width", "height", (F.col("height") > 0).alias("decoded"), "nChannels", "data")


def image_grid(images: DataFrame) -> DataFrame:
    """Pixels of decoded images; bytes are in blue, green, red order, a single channel is gray."""
    rows = images.filter("decoded").select(F.col("origin").alias("image_id"), "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    # the bytes of one row of pixels go on, not those of the image
    line = F.hex(F.expr("substring(data, y * width * nChannels + 1, width * nChannels)"))
    rows = rows.select("image_id", "y", "nChannels", line.alias("line"), F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    at = lambda k: F.conv(F.expr(f"substring(line, 2 * (x * nChannels + {k}) + 1, 2)"), 16, 10).cast("int")
    gray = F.col("nChannels") == 1
    return rows.select("image_id", "y", "x", F.when(gray, at(0)).otherwise(at(2)).alias("r"), F.when(gray, at(0)).otherwise(at(1)).alias("g"), at(0).alias("b"))


def session_folder(spark: SparkSession) -> str:
    """The session's folder below ``spark.checkpoint.dir``, which all executors share; without that setting, as in tests, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = spark.conf.get("quire.shared.dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("quire.shared.dir", found)
    return f"{found.rstrip('/')}/quire-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{uuid.uuid4().hex}/{name}"


def clear_shared(spark: SparkSession) -> None:
    """Delete all that the session has written to its folder; call it when results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
