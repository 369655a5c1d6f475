"""Source files as rows: path, name, bytes and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false")
    files = files.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder)
    return files.withColumn("source", F.element_at(F.split("path", "/"), -1))


def listed_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(source, path, length): the files of one folder, not of its subfolders; no file is opened."""
    return _files(spark, folder, pattern).select("source", "path", "length")


def _longest(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))


def source_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(source, path, length, source_hash, content): the files of one folder that can be read.

    Read by Spark's binary-file source: files are spread over tasks, and a projection without ``content`` or
    ``source_hash`` reads no bytes.  Files that are too long or fail while they are read are left out, and
    ``failed_files`` names them; none of them fails the job.
    """
    files = _files(spark, folder, pattern).where(F.col("length") <= _longest(spark))
    return files.select("source", "path", "length", F.sha2("content", 256).alias("source_hash"), "content")


def failed_files(listed: DataFrame, read: DataFrame) -> DataFrame:
    """(source, path, error): listed files that are not among those read."""
    error = F.when(F.col("length") > _longest(listed.sparkSession), "SHA-256 failed: the file is too long").otherwise("SHA-256 failed: the file could not be read")
    return listed.join(read.select("path"), "path", "left_anti").select("source", "path", error.alias("error"))


def changed_files(files: DataFrame, states: DataFrame, version: str) -> DataFrame:
    """Files whose hash and pipeline version are not yet stored: only these need extraction."""
    known = states.where(F.col("pipeline_version") == version).select("source", "source_hash").distinct()
    return files.join(known, ["source", "source_hash"], "left_anti")
