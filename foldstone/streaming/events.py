"""New events as a stream: the row-wise part of the catalogue cleaning, then counts by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldstone.operators.catalogue import clean_catalogue


def read_events(spark: SparkSession, folder: str, schema: StructType, files: int = 10) -> DataFrame:
    """Parquet files as they come, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def cleaned_stream(raw: DataFrame, country: str) -> DataFrame:
    """The same cleaning as the batch's: it keeps no state."""
    return clean_catalogue(raw, country)


def daily_counts(cleaned: DataFrame, late: str = "7 days") -> DataFrame:
    """Events a day; those later than the watermark are left out, and so state is bounded."""
    return cleaned.where("event_time is not null").withWatermark("event_time", late).groupBy(F.window("event_time", "1 day")).agg(F.count(F.lit(1)).alias("n"))
