"""Pieces that several operators share: the shared scratch folder, written intermediate tables, grouped streams."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relomap.session import ship
from relomap.tables import forget, scratch_root, written

__all__ = ["ASCII_SPACE", "flat_bytes", "forget", "free_name", "hashed_share", "held_side", "joined_by_size", "lean", "mix64", "row_ids", "runs_of", "scratch_root", "text_of", "train_side", "tune", "written"]

#: Bytes of an Arrow batch that goes to a Python worker; a batch of very long texts then stays small.
BATCH_BYTES = 4 << 20
#: ASCII white space as the contracts list it: space and the characters from tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A key with more than one in so many of all rows is a hot one: there are at most as many of those.
HOT = 10_000

def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes and by rows, so that a worker's memory does not follow the text length."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")


def row_ids() -> Iterator[int]:
    """Ids that are unique over the tasks of a stage; stable only once the rows have been written."""
    base = TaskContext.get().partitionId() << 40
    return (base + i for i in count())


def text_of(column: Column | str = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def train_side(column: str, modulus: int, held: int) -> Column:
    """False for the held-out fold: crc32 of the id's decimal text, modulo ``modulus``, equal to ``held``."""
    return ~held_side(column, modulus, held)


def held_side(column: str, modulus: int, held: int) -> Column:
    """True for the held-out fold; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus) == held


def joined_by_size(rows: DataFrame, sizes: DataFrame, keys: list[str], count: str, total: int, spread: Column, unknown: Column | None = None) -> DataFrame:
    """``rows`` with what ``sizes`` knows of their keys, where it knows anything: an inner join that no hot key slows.

    With ``unknown``, which is true of rows whose keys ``sizes`` surely has not, all rows stay: a left join.

    ``sizes`` has a row per key and in ``count`` the rows of ``rows`` that have it, ``total`` in all. Keys of more than a
    ``HOT``-th of them, of which there are at most ``HOT``, are broadcast, and their rows dealt by ``spread`` (a hash or a
    number of the row); all others are joined by a shuffle. Keys are not null.
    """
    hot = F.col(count) > max(total // HOT, 1000)
    known = [c for c in sizes.columns if c not in keys]
    heavy = sizes.where(hot).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.struct(*known).alias("_heavy"))
    light = sizes.where(~hot).select(*(F.col(k).alias(f"_own_{k}") for k in keys), F.struct(*known).alias("_light"), F.lit(0).cast("long").alias("_calm"))
    all_of = lambda prefix: reduce(lambda a, b: a & b, (F.col(k) == F.col(f"{prefix}{k}") for k in keys))
    apart = F.col("_heavy").isNotNull() if unknown is None else F.col("_heavy").isNotNull() | unknown
    tagged = rows.join(F.broadcast(heavy), all_of("_hot_"), "left").withColumn("_spread", F.when(apart, spread.bitwiseOR(F.lit(1))).otherwise(0))
    joined = tagged.join(light, all_of("_own_") & (F.col("_spread") == F.col("_calm")), "left")
    found = F.coalesce("_heavy", "_light")
    joined = joined if unknown is not None else joined.where(F.col("_heavy").isNotNull() | F.col("_light").isNotNull())
    return joined.select(*rows.columns, *(found[c].alias(c) for c in known))


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or the first of ``name_``, ``name__`` and so on that is none of the columns, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function that gives memory back when it ends: workers live on, and what they keep is lost to others."""

    @wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def hashed_share(column: Column, most: Column | float, of: Column | float) -> Column:
    """True for a share ``most / of`` of the values of a column, by their hash: a bounded sample that no task must sort."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < F.lit(float(1 << 30)) * most / F.greatest(F.lit(1.0), of if isinstance(of, Column) else F.lit(float(of)))


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal ``key`` in sorted batches, one table each. Callers bound the rows of a key."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if waiting and keys[a] != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
            last = keys[a]
    if waiting:
        yield pa.Table.from_batches(waiting)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array (null: none) end to end, and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(kind) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    flat = flat[offsets[0] : offsets[-1]] if len(offsets) else flat[:0]
    return flat, (offsets - offsets[0]) if len(offsets) else np.zeros(1, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
