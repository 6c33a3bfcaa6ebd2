"""Small helpers that the corpus operators share."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicrill.sources.shared import removed, removed_all, shared_dir
from civicrill.sources.tables import spread

#: Key of a row within one operator; never leaves it.
ROW = "__row"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, on every core also where they are few files."""
    return spread(read(spark, sf_dir, "documents"))


def cut(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that lineage ends in files that survive executors.

    ``folders`` are columns whose values get folders of their own, so that a filter on them reads no other rows. All
    files of an application lie in one folder, which discard_all() removes.
    """
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that cut() made, once all that was derived from it has been written elsewhere."""
    removed(df)


def discard_all(spark: SparkSession) -> None:
    """Remove all files that cut() wrote for this application; call it when the results have been used."""
    removed_all(spark)


def numbered(df: DataFrame) -> DataFrame:
    """A unique key for each row, equal doc_ids and equal rows included. Cut before using it twice."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
