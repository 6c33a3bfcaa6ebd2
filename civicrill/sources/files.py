"""Readers of raw files: JSON documents and trees, delimited text, XML, archives; with explicit schemas and quarantine.

Everything reads through Spark, so that paths may lie in any store Spark knows. A source that cannot be read is
reported, never taken for an empty one.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"


def json_object(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document of each file; wrong content fails loudly."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_or_none(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, str]:
    """(rows, status): a missing file gives no rows and says missing; the caller decides what that means."""
    try:
        return json_object(spark, path, schema), "ok"
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema), "missing"


def json_tree(spark: SparkSession, root: str, schema: T.StructType, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good, broken) rows of a folder tree of documents; ``keys`` name the folders above each file, outermost first.

    One broken file does not fail the scan; it stands in ``broken`` with its path and text.
    """
    with_broken = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    parsed = F.from_json("value", with_broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    read = texts.select(F.col("_metadata.file_path").alias("path"), parsed.alias("d")).select("path", "d.*")
    parts = F.split("path", "/")
    named = read.select("*", *[F.element_at(parts, i - len(keys) - 1).alias(k) for i, k in enumerate(keys)])
    return named.filter(F.col(BROKEN).isNull()).drop(BROKEN), named.filter(F.col(BROKEN).isNotNull()).select("path", BROKEN)


def delimited(spark: SparkSession, path: str, columns: list[str], separator: str = "|", id_column: str = "line") -> tuple[DataFrame, DataFrame]:
    """(rows, too_long): fixed arity; short lines are padded with empty strings, longer ones are reported."""
    parts = F.split("value", "\\" + separator if separator in "|.*+?^$()[]{}\\" else separator, -1)
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias(id_column), parts.alias("p"))
    rows = lines.filter(F.size("p") <= len(columns)).select(*[F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])
    return rows, lines.filter(F.size("p") > len(columns)).select(id_column)


def parties(text: Column) -> Column:
    """id:name;id:name as an array of structs; a name may hold colons."""
    return F.transform(F.filter(F.split(text, ";"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("id"), F.trim(F.regexp_replace(x, "^[^:]*:?", "")).alias("name")))


def sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose delimiter, semicolon or comma, is the more frequent in the header."""
    header = spark.read.text(path).first()
    text = header["value"] if header else ""
    return spark.read.option("header", True).option("sep", ";" if text.count(";") > text.count(",") else ",").csv(path)


def short_headers(df: DataFrame) -> DataFrame:
    """Columns named by what stands after the last colon of a header, for extracts whose long titles drift from year to year."""
    return df.toDF(*[c.rsplit(":", 1)[-1].strip() for c in df.columns])


def xml_rows(spark: SparkSession, path: str, row: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


#: Characters of the bytes from 128 on, in Latin-1 (which Spark decodes) and in windows-1250 (which it does not).
_HIGH = bytes(range(128, 256))
LATIN_1, CENTRAL = _HIGH.decode("latin-1"), _HIGH.decode("cp1250", errors="replace")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, else as windows-1250."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.translate(F.decode(content, "ISO-8859-1"), LATIN_1, CENTRAL))


def kind_by_bytes(content: Column) -> Column:
    """File kind by its first bytes, not by its name."""
    start = F.hex(F.substring(content, 1, 4))
    return F.when(start.startswith("25504446"), "pdf").when(start == "504B0304", "zip").when(start.startswith("D0CF11E0"), "ole").otherwise("text")


def archive_members(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(archive, member, content): members of ZIP archives, one archive in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        yield pd.DataFrame({"archive": [name], "member": [m], "content": [z.read(m)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, content binary")


#: Preferred form of a table that an archive holds several times, best first.
FORMS = ("csv_od/", ".csv", ".xml")


def best_form(members: DataFrame) -> DataFrame:
    """One member of each table stem: the best form there is."""
    name = F.element_at(F.split("member", "/"), -1)
    rank = F.when(F.col("member").contains(FORMS[0]), 0).when(F.lower(name).endswith(FORMS[1]), 1).when(F.lower(name).endswith(FORMS[2]), 2).otherwise(9)
    ranked = members.withColumns({"stem": F.lower(F.regexp_replace(name, "\\.[^.]*$", "")), "form": rank}).filter("form < 9")
    best = ranked.groupBy("archive", "stem").agg(F.min_by("member", F.struct("form", "member")).alias("member"))
    return members.join(best, ["archive", "member"])


def source_status(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, status): ok or missing for each expected entity, unexpected for others; an anti-join on both sides."""
    f, e = found.select(key).distinct().withColumn("f", F.lit(1)), expected.select(key).distinct().withColumn("e", F.lit(1))
    return e.join(f, key, "full_outer").select(key, F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("ok").alias("status"))


def require(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """``found``, or an error that names missing entities: what could not be read is not nothing."""
    missing = [r[key] for r in source_status(found, expected, key).filter("status = 'missing'").limit(5).collect()]
    if missing:
        raise ValueError(f"no source for {', '.join(map(str, missing))}")
    return found
