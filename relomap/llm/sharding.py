"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Groups of equal texts are the items; each goes to the shard whose residual capacity has the highest dot product with
it. The packing itself sees a bounded number of items whatever the input: a group of at least ``1 / HEAVY`` of all bytes,
tokens or rows is an item of its own (there are at most ``3 * HEAVY`` of them), and all lighter groups share ``LIGHT`` hash buckets, whole
groups to a bucket. Only a group that passes a shard's fair share is cut, into pieces of at most that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relomap.llm.common import text_of, tune, written


@dataclass(frozen=True)
class ShardOptions:
    shards: int = 24
    #: A group with this fraction (one over it) of all bytes, tokens or rows is an item of its own.
    heavy: int = 2400
    #: Hash buckets that the lighter groups share.
    light: int = 12000
    #: Rows of an item that one task numbers.
    numbered: int = 50_000


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shards for items (rows of non-negative loads): packed by dot product, then evened out by exchanges."""
    return _even_out(items, pack(items, shards), shards)


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Largest first, highest dot product with residual capacity.

    Loads are scaled by each dimension's total, so that a capacity is ``1 / shards`` everywhere. A shard is open for an
    item while the item fits the residual in every dimension; if it fits nowhere, the shard with the largest least
    residual takes it. Ties go to the first item and the first shard.
    """
    total = items.sum(axis=0).astype(np.float64)
    loads = items / np.where(total > 0, total, 1)
    capacity = np.where(total > 0, 1.0 / shards, 0.0)
    residual = np.tile(capacity, (shards, 1))
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-loads.max(axis=1), kind="stable"):
        fits = (residual - loads[i] >= -1e-12).all(axis=1)
        score = np.where(fits, residual @ loads[i], -np.inf)
        k = int(score.argmax()) if fits.any() else int((residual - loads[i]).min(axis=1).argmax())
        out[i] = k
        residual[k] -= loads[i]
    return out


def _even_out(items: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Move or swap items between shards while that evens them out, first in all dimensions and last in bytes alone."""
    mean = np.maximum(items.sum(axis=0) / shards, 1e-9)
    loads = items / mean
    fill = np.stack([np.bincount(shard, weights=loads[:, j], minlength=shards) for j in range(items.shape[1])], axis=1)
    sizes = items[:, 0].astype(np.int64)

    def options(hi: int, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items of one shard and of another (-1: none), and what their exchange takes off the first, item by item."""
        mine, theirs = np.flatnonzero(shard == hi), np.flatnonzero(shard == lo)
        theirs = theirs[np.argsort(sizes[theirs], kind="stable")][:: max(1, len(theirs) // 200)]
        theirs = np.append(theirs, -1)
        other = np.where(theirs[:, None] >= 0, loads[theirs], 0.0)
        return mine, theirs, loads[mine][:, None, :] - other[None, :, :]

    def exchange(hi: int, lo: int, a: int, b: int, moved: np.ndarray) -> None:
        shard[a] = lo
        if b >= 0:
            shard[b] = hi
        fill[hi] -= moved
        fill[lo] += moved

    for _ in range(40 * shards):
        best = None
        for j in range(items.shape[1]):
            hi, lo = int(fill[:, j].argmax()), int(fill[:, j].argmin())
            if hi == lo:
                continue
            mine, theirs, moved = options(hi, lo)
            if not len(mine):
                continue
            gain = ((fill[hi] - 1) ** 2 + (fill[lo] - 1) ** 2).sum() - ((fill[hi] - moved - 1) ** 2 + (fill[lo] + moved - 1) ** 2).sum(axis=2)
            x, y = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[x, y] > 1e-10 and (best is None or gain[x, y] > best[0]):
                best = (gain[x, y], hi, lo, mine[x], theirs[y], moved[x, y])
        if best is None:
            break
        exchange(*best[1:])
    for _ in range(40 * shards):
        total = np.bincount(shard, weights=sizes, minlength=shards).astype(np.int64)
        hi, lo = int(total.argmax()), int(total.argmin())
        gap = int(total[hi] - total[lo])
        if gap <= 1:
            break
        mine, theirs, moved = options(hi, lo)
        taken = np.rint(moved[:, :, 0] * mean[0]).astype(np.int64)
        # Of the exchanges that close most of the gap, the one that shifts tokens and rows least.
        off = np.abs(taken - gap / 2)
        if not off.size or off.min() >= gap / 2:
            break
        fits = off <= max(1.0, off.min(), min(gap / 4, off.min() * 2))
        shift = np.where(fits, np.abs(moved[:, :, 1:]).sum(axis=2), np.inf)
        x, y = np.unravel_index(int(shift.argmin()), shift.shape)
        if not 0 < taken[x, y] < gap:
            x, y = np.unravel_index(int(off.argmin()), off.shape)
            if not 0 < taken[x, y] < gap:
                break
        exchange(hi, lo, mine[x], theirs[y], moved[x, y])
    return shard


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: ShardOptions | None = None) -> DataFrame:
    """Put every row into one of ``options.shards`` shards of nearly equal bytes, tokens and rows.

    Columns: ``doc_id``, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``n_tokens`` (white-space separated words),
    ``shard``, ``slot`` (gapless from 0 within the shard). One row per input row. Rows of equal text share a shard unless
    their group is too large for that (see the module).

    Defined cases: a null text has no bytes, so size 8, checksum 0, and shares a group with empty texts; null ids are
    rows as any other; repeated rows get a slot each; an empty table gives an empty result; other columns are ignored.
    """
    spark, o = docs.sparkSession, options or ShardOptions()
    tune(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t")).select(
        "doc_id",
        (F.octet_length("_t") + 8).cast("long").alias("size"),
        F.crc32(F.col("_t").cast("binary")).alias("text_crc32"),
        F.regexp_count("_t", F.lit(r"[^ \t-\r]+")).cast("long").alias("n_tokens"),
        F.md5(F.col("_t").cast("binary")).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(spark, base, "sizes")  # the rows keep their numbers
    loads = [F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("r")]
    total = rows.agg(*loads).first()
    share = F.greatest(*(F.col(c) / max(1, x or 0) for c, x in zip("btr", total, strict=True)))
    # The heavy groups: a bounded number of rows, each above a fixed fraction of the whole.
    heavy = rows.groupBy("group").agg(*loads).where(share >= 1 / o.heavy)
    heavy_rows = heavy.select("group", F.least(F.ceil(share * o.shards), "r").cast("int").alias("pieces")).collect()
    names = {g: i for i, (g, _) in enumerate(sorted(heavy_rows))}
    known = spark.createDataFrame([(g, names[g], n) for g, n in heavy_rows], "group string, heavy int, pieces int")

    piece = F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")
    bucket = F.pmod(F.xxhash64("group"), F.lit(o.light)).cast("int")
    unit = F.when(F.col("heavy").isNull(), F.concat(F.lit("l"), bucket.cast("string"))).otherwise(F.concat(F.lit("h"), F.col("heavy").cast("string"), F.lit("."), piece.cast("string")))
    units = rows.join(F.broadcast(known), "group", "left").withColumn("unit", unit).drop("group", "heavy", "pieces")
    found = sorted(tuple(r) for r in units.groupBy("unit").agg(*loads).collect())  # at most light + 3 * (heavy + shards) rows
    items = np.array([r[1:] for r in found], dtype=np.int64).reshape(-1, 3)
    shard = place(items, o.shards)
    start, seen = np.zeros(len(found), dtype=np.int64), np.zeros(o.shards, dtype=np.int64)
    for i, k in enumerate(shard):
        start[i], seen[k] = seen[k], seen[k] + items[i, 2]
    plan = [(u[0], int(k), int(s), -(-int(u[3]) // o.numbered)) for u, k, s in zip(found, shard, start, strict=True)]
    dealt = units.join(F.broadcast(spark.createDataFrame(plan, "unit string, shard int, start long, parts int")), "unit")
    # The rows of an item are numbered in parts, so that a large item is not one task's.
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "row"), F.col("parts")).cast("int"))
    earlier = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("unit", "part").agg(F.count(F.lit(1)).alias("n")).select("unit", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("unit", "part").orderBy("doc_id", "text_crc32", "size", "row")
    return (
        dealt.join(parts, ["unit", "part"])
        .withColumn("slot", (F.col("start") + F.col("before") + F.row_number().over(order) - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", "n_tokens", "shard", "slot")
    )
