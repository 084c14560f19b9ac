"""Sets of payload files as sources: what is malformed is kept apart and counted, never lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import stage

#: Of an XML record that does not parse.
MALFORMED = "malformed"


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Records of XML files, large ones split between tasks at ``row_tag``: the schema's columns, those of a partitioned folder, ``file`` and ``malformed``.

    A record that is no XML has its text in ``malformed`` and null elsewhere;
    records are cut out before they are parsed, so the next ones are not lost
    with it.  The parsed rows are staged, so that both kinds are read from one scan.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).option("useLegacyXMLParser", "true").schema(f"{schema}, {MALFORMED} string").load(path)
    return stage(rows.select("*", F.col("_metadata.file_name").alias("file")), "xml_records")


def whole_texts(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """Text files as one row each: file, body, and in ``malformed`` the body of one that opens more blocks than it closes, or has none.

    A file is held whole, so this is for files of a few megabytes.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    opened, closed = (F.size(F.split("body", rf"(?m)^{mark}\s*$")) - 1 for mark in (begin, end))
    return rows.withColumn(MALFORMED, F.when((opened != closed) | (opened == 0), F.col("body")))


def quarantine(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, records, malformed): how many records there are, and how many of them were set aside."""
    return rows.groupBy(*by).agg(F.count("*").alias("records"), F.count(MALFORMED).alias("malformed"))


def sound(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(MALFORMED).isNull()).drop(MALFORMED)
