"""Live samples: JSON messages with tag→value maps, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_DDL = "timestamp DOUBLE, values MAP<STRING,DOUBLE>, quality MAP<STRING,INT>, source STRING"


def read_sample_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.schema(SAMPLE_DDL).option("maxFilesPerTrigger", files_per_trigger).json(folder))


def parse_samples(messages: DataFrame, column: str = "value") -> DataFrame:
    """Text messages (for instance from a log or a queue) to sample structs."""
    return messages.select(F.from_json(F.col(column).cast("string"), SAMPLE_DDL).alias("s")).select("s.*")


def explode_samples(samples: DataFrame, declared: DataFrame, asset: str = "plant",
                    scenario: str = "live") -> DataFrame:
    """One row per declared tag and sample; unknown tags are dropped, missing ones null.

    Samples without a usable time are dropped.  `declared` is the tag dimension.
    """
    tags = [r.tag for r in declared.select("tag").collect()]  # dimension rows
    d = samples.filter(F.col("timestamp").isNotNull() & ~F.isnan("timestamp"))
    d = d.withColumn("tag", F.explode(F.array(*[F.lit(t) for t in tags])))
    v = F.try_element_at(F.col("values"), F.col("tag"))
    return d.select(
        F.lit(asset).alias("asset"), F.lit(scenario).alias("scenario"),
        F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")).alias("ts"), "tag",
        F.when(~F.isnan(v), v).alias("value"), F.try_element_at(F.col("quality"), F.col("tag")).alias("quality"),
        "source")
