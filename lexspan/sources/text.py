"""Sources and sinks of texts: literal files, fragment corpora, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import as_record
from .corpus import FRAGMENT, corpus
from .log import append

__all__ = ["FRAGMENT", "append", "corpus", "fragments", "literal_files", "write_records", "write_table"]


def literal_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; line ends and a byte order mark stay. A file that is not UTF-8 is an error."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string"))
    return files.select("path", text.alias("text"))


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of fragments as JSON lines, with a declared schema: a line that does not fit is an error."""
    return spark.read.schema(FRAGMENT).option("mode", "FAILFAST").json(path)


def write_records(rows: DataFrame, path: str) -> None:
    as_record(rows).write.text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated with headings; tabs and line ends inside cells become spaces."""
    cell = lambda c: F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ").alias(c)
    rows.select(*map(cell, rows.columns)).write.option("sep", "\t").option("header", "true").csv(path)
