"""The candidate registry as a table: numbering, soft removal, replacement, lookups and counts.

A registry has one row per candidate with ``candidate_id``, ``filename``, ``kind``, ``canonical_text`` and ``active``. Its
indexes (ids by file, ids by content) are groupings, computed when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relomap.tables import with_ordinals


def number_candidates(candidates: DataFrame, *order: str, start: int = 0) -> DataFrame:
    """Dense ids in the order of ``order``, all active."""
    return with_ordinals(candidates, order, "candidate_id", start).withColumn("active", F.lit(True))


def remove_files(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Mark the candidates of ``files`` (``filename``) inactive; ids stay taken."""
    gone = files.select("filename").distinct().withColumn("_gone", F.lit(True))
    return registry.join(gone, "filename", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).select(registry.columns)


def add_candidates(registry: DataFrame, candidates: DataFrame, *order: str) -> DataFrame:
    """Append candidates with the next ids. The highest id so far is one number, read from the registry."""
    top = registry.agg(F.max("candidate_id")).first()[0]
    return registry.unionByName(number_candidates(candidates, *order, start=0 if top is None else top + 1).select(registry.columns))


def replace_files(registry: DataFrame, candidates: DataFrame, *order: str) -> DataFrame:
    """Remove the files of ``candidates``, then add these under new ids."""
    return add_candidates(remove_files(registry, candidates), candidates, *order)


def file_candidates(registry: DataFrame, filename: str) -> DataFrame:
    """Active candidates of one file."""
    return registry.where(F.col("active") & (F.col("filename") == filename))


def has_file(registry: DataFrame, filename: str) -> bool:
    return not file_candidates(registry, filename).isEmpty()


def counts(registry: DataFrame, key: str | Column = "canonical_text") -> DataFrame:
    """One row: ``files``, ``total_records``, ``active_candidates``, ``inactive_candidates``, ``buckets`` (active contents)."""
    active = F.col("active")
    return registry.agg(
        F.count_distinct(F.when(active, F.col("filename"))).alias("files"),
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(active).alias("active_candidates"),
        F.count_if(~active).alias("inactive_candidates"),
        F.count_distinct(F.when(active, F.col(key) if isinstance(key, str) else key)).alias("buckets"),
    )


def file_stats(registry: DataFrame) -> DataFrame:
    """Per file, in order of name: ``ids``, ``active``, ``inactive``, ``dels``, ``ins``."""
    return (
        registry.groupBy("filename")
        .agg(
            F.count(F.lit(1)).alias("ids"),
            F.count_if("active").alias("active"),
            F.count_if(~F.col("active")).alias("inactive"),
            F.count_if(F.col("kind") == "delete").alias("dels"),
            F.count_if(F.col("kind") == "insert").alias("ins"),
        )
        .orderBy("filename")
    )
