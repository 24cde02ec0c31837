"""Scenario files in, long readings out, and idempotent writes back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import physical_name


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def partition_value(name: str) -> Column:
    """Scenario from a `name=value` folder, for scenarios spread over many files."""
    return F.regexp_extract(F.col("_metadata.file_path"), f"/{name}=([^/]+)/", 1)


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """The different first lines of the files, each with the files that have it."""
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at")).filter("start = 0")
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    return {r.header: r.paths for r in first.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()}


def read_scenarios(spark: SparkSession, paths: str | Sequence[str], tags: Sequence[str],
                   asset: str = "plant", time_column: str = "timestamp",
                   scenario: Column | None = None) -> DataFrame:
    """Wide samples of one or many scenario CSV files; the scenario is the file stem.

    Files are grouped by their header line and each group is read with its own columns, so headers may
    differ in order and number.  Absent tags are null; NaN text becomes null.
    """
    out = None
    for files in headers(spark, [paths] if isinstance(paths, str) else paths).values():
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(files)
        cols = [(F.expr(f"try_cast(`{t}` AS DOUBLE)") if t in raw.columns else F.lit(None).cast("double")) for t in tags]
        clean = [F.when(~F.isnan(c), c).alias(physical_name(t)) for c, t in zip(cols, tags)]
        d = raw.select(
            F.lit(asset).alias("asset"),
            (file_stem(F.col("_metadata.file_path")) if scenario is None else scenario).alias("scenario"),
            F.to_timestamp(F.col(f"`{time_column}`")).alias("ts"), *clean)
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise FileNotFoundError(f"no scenario file under {paths}")
    return out


def existing_scenarios(spark: SparkSession, folder: str, wanted: Sequence[str]) -> DataFrame:
    """Which of the wanted scenarios have a file; an error when none has."""
    stems = list_scenarios(spark, folder)
    found = stems.filter(F.col("scenario").isin(list(wanted)))
    if found.isEmpty():
        raise FileNotFoundError(f"none of the scenarios exist under {folder}")
    return found


def list_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted file stems of a folder of CSV files; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    return files.select(file_stem(F.col("path")).alias("scenario")).distinct().orderBy("scenario")


def to_long(wide: DataFrame, tags: Sequence[str], keys: Sequence[str] = ("asset", "scenario", "ts")) -> DataFrame:
    """Wide columns (underscored) to (keys, tag, value) with dotted tags; nulls are absent."""
    d = wide.withColumnsRenamed({physical_name(t): t for t in tags if physical_name(t) in wide.columns})
    present = [t for t in tags if t in d.columns]
    long = d.unpivot(list(keys), [F.col(f"`{t}`") for t in present], "tag", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def to_wide(readings: DataFrame, tags: Sequence[str], keys: Sequence[str] = ("asset", "scenario", "ts")) -> DataFrame:
    """Declared tags as columns; anything undeclared is dropped, absent tags are null."""
    d = readings.filter(F.col("tag").isin(list(tags)))
    d = d.groupBy(*keys).agg(*[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(physical_name(t))
                               for t in tags])
    return d


def new_samples(incoming: DataFrame, stored: DataFrame, key: Sequence[str], first_by: Sequence) -> DataFrame:
    """Incoming rows whose key is not stored; the first of several incoming duplicates wins."""
    w = Window.partitionBy(*key).orderBy(*first_by)
    fresh = incoming.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")
    return fresh.join(stored.select(*key).distinct(), list(key), "left_anti")


def reingest(stored: DataFrame, incoming: DataFrame, force: bool, scenario: str = "scenario") -> DataFrame:
    """Stored table after ingest: present scenarios are skipped, or replaced with `force`."""
    have = stored.select(scenario).distinct()
    names = incoming.select(scenario).distinct()
    if force:
        return stored.join(names, scenario, "left_anti").unionByName(incoming)
    return stored.unionByName(incoming.join(have, scenario, "left_anti"))


def write_samples(df: DataFrame, path: str, replace: bool = False) -> None:
    """Parquet partitioned by scenario; `replace` rewrites the touched scenarios whole, whatever weeks they had.

    A scenario is written by as many tasks as it has weeks, each week in time order, so that time filters
    prune row groups.
    """
    week = F.date_trunc("week", "ts")
    writer = df.repartition(F.col("scenario"), week).sortWithinPartitions("scenario", "ts").write.partitionBy("scenario")
    if replace:
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode("append").parquet(path)


def normalise_events(events: DataFrame, asset: Column, tag: Column, scenario: Column | str = "live",
                     value: str = "value", ts: str = "ts") -> DataFrame:
    """Any event table as readings: zoned timestamps, NaN to null."""
    s = scenario if isinstance(scenario, Column) else F.lit(scenario)
    v = F.col(value).cast("double")
    return events.select(asset.cast("string").alias("asset"), s.alias("scenario"),
                         F.col(ts).cast("timestamp").alias("ts"), tag.cast("string").alias("tag"),
                         F.when(~F.isnan(v), v).alias("value"))
