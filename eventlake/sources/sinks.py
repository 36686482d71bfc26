"""Tables to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_catalog(events: DataFrame, path: str, run: str) -> None:
    """One partition per run; the current catalog is the last one."""
    events.withColumn("run_ts", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_ts").parquet(path)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of the last run: only its partition is read."""
    runs = spark.read.parquet(path)
    last = runs.select("run_ts").distinct().agg(F.max("run_ts")).first()[0]
    return runs.where(F.col("run_ts") == last).drop("run_ts")


def write_lite(events: DataFrame, columns: list[str], path: str) -> None:
    """The listed columns only; fails unless they are smaller than the whole."""
    size = [F.coalesce(F.sum(F.length(F.to_json(F.struct(*c)))), F.lit(0)) for c in (columns, events.columns)]
    small, full = events.agg(*size).first()
    if full and small >= full:
        raise ValueError(f"the lite projection has {small} characters, the catalog {full}")
    events.select(*columns).write.mode("overwrite").parquet(path)


def write_agent_feed(feed: DataFrame, path: str, version: int = 1) -> None:
    """One JSON object a line, each with the version of its layout, as lines may be read apart from each other."""
    row = F.struct(F.lit(version).alias("schema_version"), *feed.columns)
    feed.select(F.to_json(row).alias("value")).write.mode("overwrite").text(path)


def write_atom_rows(events: DataFrame, path: str, limit: int = 50) -> None:
    """Newest entries first. Expects id, title, link, updated, summary."""
    top = events.orderBy(F.desc("updated"), "id").limit(min(limit, 200))
    top.select("id", "title", "link", F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"), "summary").coalesce(1).write.mode("overwrite").format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)


def write_weekly(rows: DataFrame, path: str) -> None:
    """Only weeks that aren't there yet: what is published stays."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select("week_id").distinct()
        rows = rows.join(done, "week_id", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").partitionBy("week_id").parquet(path)
