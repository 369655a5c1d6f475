"""Incremental page scoring as a stream, beside the batch operators.

New page files are scored as they arrive; late repeats of a page are dropped within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import text_quality


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Pages of a growing folder of Parquet files, or of one file; the schema is that of what is already there."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def scored_stream(pages: DataFrame, late: str = "7 days") -> DataFrame:
    """Stream of (source, page, ingested_at, score, quality): each page once, if it is not later than ``late``."""
    rows = pages.where("source IS NOT NULL AND page IS NOT NULL AND ingested_at IS NOT NULL").withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    once = rows.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["source", "page"])
    return text_quality(once).select("source", "page", "ingested_at", "score", "quality")


def quality_by_day(pages: DataFrame, late: str = "7 days") -> DataFrame:
    """Stream of (day, quality, pages): stored quality labels per day of ingestion."""
    rows = pages.where("ingested_at IS NOT NULL").withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return rows.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", "1 day").alias("w"), F.coalesce("quality", F.lit("unknown")).alias("quality")).agg(F.count(F.lit(1)).alias("pages")).select(F.col("w.start").alias("day"), "quality", "pages")
