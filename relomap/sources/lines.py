"""Line scans of text columns and files, and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_lines(texts: DataFrame, id_col: str, text_col: str, strip_cr: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``line_no`` from 1, ``line``, and the columns ``keep`` of the text. The end of a last line that is ended by a
    line feed opens no further line."""
    lines = texts.select(F.col(id_col).alias("id"), *keep, F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\n\\z", ""), "\n", -1)).alias("_n", "line"), (F.coalesce(F.col(text_col), F.lit("")) == "").alias("_none"))
    line = F.regexp_replace("line", "\r\\z", "") if strip_cr else F.col("line")
    return lines.where("NOT _none").select("id", (F.col("_n") + 1).cast("long").alias("line_no"), line.alias("line"), *keep)


def read_lines(spark: SparkSession, path: str, strip_cr: bool = False) -> DataFrame:
    """Lines of whole files: ``id`` is the path."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return scan_lines(files, "path", "value", strip_cr)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents that span lines, one row each."""
    return spark.read.json(path, multiLine=True)
