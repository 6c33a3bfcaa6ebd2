"""Writers: public JSON, partitioned tables without stale entities, feature collections, the run log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "name string, started timestamp, seconds double, rows long, ok boolean, error string"


def public_json(df: DataFrame, path: str) -> None:
    """JSON lines; the job's commit replaces the old folder as a whole."""
    df.write.mode("overwrite").json(path)


def by_entity(df: DataFrame, path: str, *keys: str) -> None:
    """One folder for each entity; a static overwrite also removes entities that are gone."""
    df.repartition(*keys).write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy(*keys).parquet(path)


def feature_collection(df: DataFrame, geometry: str, name: str, licence: str) -> DataFrame:
    """One JSON text with all features and where they come from; for layers of bounded size, which a page shows."""
    own = [c for c in df.columns if c != geometry]
    feature = F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.struct(*own).alias("properties"))
    return df.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.lit(name).alias("name"), F.lit(licence).alias("licence"), F.sort_array(F.collect_list(feature)).alias("features"))).alias("json"))


def logged(spark: SparkSession, log_path: str, name: str, job: Callable[[], DataFrame], path: str) -> bool:
    """Run a job, write its rows as Parquet and append one row to the run log, whether it fails or not."""
    started, error, rows = time.time(), None, 0
    try:
        job().write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path).count()
    except Exception as e:  # every failure of a job is a row of the log
        error = f"{type(e).__name__}: {e}"[:500]
    row = spark.sql("SELECT 1").select(F.lit(name).alias("name"), F.timestamp_seconds(F.lit(started)).alias("started"), F.lit(time.time() - started).alias("seconds"), F.lit(rows).cast("long").alias("rows"), F.lit(error is None).alias("ok"), F.lit(error).cast("string").alias("error"))
    row.write.mode("append").parquet(log_path)
    return error is None
