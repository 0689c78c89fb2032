"""Intermediate tables in the folder that all executors share, and numbering that is fixed by them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own_root = ""
_MASK = (1 << 33) - 1


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given; a temporary one only where both
    are unset and all executors are threads of this process, as in tests."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        given = context._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if not root and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or _make_own_root()).rstrip("/")


def _make_own_root() -> str:
    global _own_root
    _own_root = _own_root or "file://" + tempfile.mkdtemp(prefix="relomap-")
    return _own_root


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors, fixes row ids."""
    path = f"{scratch_root(spark)}/relomap-tables/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._relomap_path = path  # type: ignore[attr-defined]
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_relomap_path", None)
        if path:
            _remove(spark, path)
            with contextlib.suppress(ValueError):
                _written.remove((spark, path))


def tables_so_far() -> int:
    """A mark for ``forget_since``."""
    return len(_written)


def forget_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the tables written after a mark but those to keep: what a finished step needed is of no further use."""
    kept = {getattr(t, "_relomap_path", None) for t in keep}
    for owner, path in _written[mark:]:
        if owner is spark and path not in kept:
            _remove(spark, path)
            _written.remove((owner, path))


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            _remove(spark, path)


def with_ordinals(rows: DataFrame, order: tuple[str, ...], name: str, start: int = 0) -> DataFrame:
    """Dense numbers from ``start`` in the order of ``order``, without a task that sees all rows.

    The rows are sorted by range and written with their place in their partition, once, so that the numbers do not
    depend on how a plan is run again; each partition is then numbered after the rows of those before it.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    fixed = written(spark, placed, "ordered").withColumn("_part", F.shiftright("_place", 33))
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit(_MASK)) + start
    return fixed.join(F.broadcast(before), "_part").withColumn(name, number.cast("long")).drop("_part", "_place", "_before")
