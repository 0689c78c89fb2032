"""Incremental registry: a stream of files' candidates keeps a table of active candidates up to date.

This goes beyond batch detection: each micro-batch replaces the files it mentions. Versions of the table are folders
``v=<n>``; the last complete one is current, so a batch that is run again after a failure writes the same version anew.
A batch reads the version before it; older ones are deleted, so two are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from relomap.operators.registry import number_candidates, replace_files

COLUMNS = ("candidate_id", "filename", "kind", "canonical_text", "raw_text", "active")


def _folders(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def _forget(spark: SparkSession, path: str, versions: list[int]) -> None:
    jvm = spark.sparkContext._jvm
    for v in versions:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last complete version, or the last before a given one; None if there is none."""
    versions = [v for v in _folders(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v={versions[-1]}") if versions else None


def apply_batch(path: str):
    """A ``foreachBatch`` function that replaces the files of each batch in the table at ``path``."""

    def apply(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        known = current(spark, path, before=number)
        candidates = batch.select("filename", "kind", "canonical_text", "raw_text")
        order = ("filename", "canonical_text", "kind", "raw_text")
        updated = number_candidates(candidates, *order) if known is None else replace_files(known, candidates, *order)
        updated.select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/v={number}")
        _forget(spark, path, [v for v in _folders(spark, path) if v < number][:-1])

    return apply


def maintain(candidates: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the stream: ``candidates`` has ``filename``, ``kind``, ``canonical_text``, ``raw_text``."""
    writer = candidates.writeStream.foreachBatch(apply_batch(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
