"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is the pair of values of its byte polynomial modulo two primes, at two bases. Chunks of a text are
hashed in parallel (one matrix product for all chunks of a batch) and combined by length-shifted arithmetic:
``H(ab) = H(a) * base**len(b) + H(b)``, so a huge document needs no sequential pass. Texts with equal fingerprints are
then compared chunk by chunk, in a stream over sorted partitions, with the text that represents their fingerprint. Only
texts whose fingerprint may occur twice are dealt: a bitmap of the fingerprints of several rows says so, at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relomap.llm.common import ASCII_SPACE, HOT, flat_bytes, forget, joined_by_size, lean, text_of, tune, written

#: Bytes of a chunk; the last chunk's bytes are aligned to the end of the text, so the first one may be short.
CHUNK = 512
#: Bytes of texts that are hashed in one matrix product.
SLICE = 2 << 20
#: Bytes that one step of the comparison looks at.
COMPARE = 1 << 16
#: Rows of one hot fingerprint that share a comparison partition.
ROWS_PER_SALT = 2000
#: Words of 64 bits in the bitmap of fingerprints that several rows have; with more of these it lets more single rows pass.
WORDS = 1 << 18


@dataclass(frozen=True)
class Polynomial:
    """Byte polynomials modulo ``primes`` (below 2**32) at ``bases``; two residues make one fingerprint."""

    primes: tuple[int, int] = (2147483647, 2147483629)
    bases: tuple[int, int] = (1000003, 69069069)

    def of(self, data: bytes) -> tuple[int, int]:
        """Fingerprint of bytes, the plain way."""
        out = []
        for p, b in zip(self.primes, self.bases, strict=True):
            h = 0
            for x in data:
                h = (h * b + x + 1) % p
            out.append(h)
        return out[0], out[1]

    def combine(self, left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
        """Fingerprint of a concatenation from those of its parts and the length of the right part."""
        return tuple(  # type: ignore[return-value]
            (a * pow(b, right_length, p) + c) % p
            for a, c, p, b in zip(left, right, self.primes, self.bases, strict=True)
        )

    def many(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Fingerprints of the texts ``flat[offsets[i]:offsets[i + 1]]`` as an (n, 2) uint64 array."""
        lengths = np.diff(offsets)
        chunks = -(-lengths // CHUNK)
        out = np.zeros((len(lengths), 2), dtype=np.uint64)
        first = 0
        while first < len(lengths):  # texts by slices of bounded size; a longer text is a slice of its own
            last = int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1
            last = min(max(last, first + 1), len(lengths))
            out[first:last] = self._slice(flat, offsets, lengths, chunks, first, last)
            first = last
        return out

    def _slice(self, flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, chunks: np.ndarray, first: int, last: int) -> np.ndarray:
        own = chunks[first:last]
        begins = np.concatenate([[0], np.cumsum(own)])
        out = np.zeros((last - first, 2), dtype=np.uint64)
        state = np.zeros((last - first, 2), dtype=np.int64)
        block = max(1, SLICE // CHUNK)
        carried: list[np.ndarray] = []
        for at in range(0, int(begins[-1]), block):  # the hashes of chunks, whichever text they are of
            upto = min(at + block, int(begins[-1]))
            grid = np.zeros((upto - at, CHUNK), dtype=np.float64)
            plain = grid.reshape(-1)
            a, b = int(np.searchsorted(begins, at, side="right")) - 1, int(np.searchsorted(begins, upto, side="left"))
            for i in range(a, b):
                stop = (int(begins[i + 1]) - at) * CHUNK
                start = stop - int(lengths[first + i])
                take = slice(int(offsets[first + i]), int(offsets[first + i + 1]))
                lo, hi = max(start, 0), min(stop, len(plain))
                if hi > lo:
                    plain[lo:hi] = flat[take.start + lo - start : take.start + hi - start]
                    plain[lo:hi] += 1.0
            carried.append(np.stack([(grid @ w).astype(np.int64) % p for w, p in zip(self._powers(), self.primes, strict=True)], axis=1))
        hashes = np.concatenate(carried) if carried else np.zeros((0, 2), dtype=np.int64)
        for step in range(int(own.max()) if len(own) else 0):  # Horner over the chunks of all texts at once
            live = np.flatnonzero(own > step)
            for k, (p, base) in enumerate(zip(self.primes, self.bases, strict=True)):
                shifted = state[live, k].astype(np.uint64) * np.uint64(pow(base, CHUNK, p)) % np.uint64(p)
                state[live, k] = (shifted.astype(np.int64) + hashes[begins[live] + step, k]) % p
        out[:] = state.astype(np.uint64)
        return out

    def _powers(self) -> list[np.ndarray]:
        return [np.array([pow(b, CHUNK - 1 - i, p) for i in range(CHUNK)], dtype=np.float64) for p, b in zip(self.primes, self.bases, strict=True)]


def fingerprint_column(column: Column, polynomial: Polynomial) -> Column:
    """The fingerprint of a string column as one long: two residues below 2**31, 62 bits."""

    @F.pandas_udf("long")  # type: ignore[call-overload]
    def fingerprint(texts: pd.Series) -> pd.Series:
        flat, offsets = flat_bytes(pa.array(texts, type=pa.large_string()))
        both = polynomial.many(flat, offsets)
        return pd.Series((both[:, 0] << np.uint64(31) | both[:, 1]).astype(np.int64))

    return fingerprint(column)


def same_bytes(left: memoryview, right: memoryview) -> bool:
    """Chunkwise comparison; stops at the first chunk that differs."""
    return len(left) == len(right) and all(left[i : i + COMPARE] == right[i : i + COMPARE] for i in range(0, len(left), COMPARE))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (fingerprint, salt, representative first): does each text equal its representative's, the first one's?"""
    key, head = None, memoryview(b"")
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        flat, offsets = flat_bytes(cols["norm"])
        view, same, own = memoryview(flat), [], cols["own"].to_pylist()
        for i, now in enumerate(zip(cols["fp"].to_pylist(), cols["salt"].to_pylist(), strict=True)):
            text = view[offsets[i] : offsets[i + 1]]
            if now != key:
                key, head = now, memoryview(bytes(text))
            same.append(same_bytes(head, text))
        keep = pa.array(own)
        kept = ["doc_id", "n_points", "sha", "fp", "row"]
        out = pa.RecordBatch.from_arrays([*(cols[c] for c in kept), pa.array(same)], [*kept, "same"])
        yield out.filter(keep)


def _place() -> tuple[Column, Column]:
    """Where a fingerprint stands in the bitmap: its word, and that word with its bit alone."""
    mixed = F.xxhash64("fp")
    return F.pmod(mixed, F.lit(WORDS)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(mixed, 58).cast("int")).alias("bit")


def _bitmap(groups: DataFrame) -> DataFrame:
    """``word``, ``bits`` of the fingerprints that several rows have: a row per word that is not 0."""
    return groups.where("n > 1").select(*_place()).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _parted(frame: DataFrame, bitmap: DataFrame, inside: bool) -> DataFrame:
    """The rows of ``frame`` whose fingerprint is in the bitmap, or those whose is not; no row of ``frame`` is dealt."""
    word, bit = _place()
    placed = frame.withColumns({"word": word, "_bit": bit}).join(F.broadcast(bitmap), "word", "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return placed.where(hit if inside else ~hit).select(*frame.columns)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", polynomial: Polynomial | None = None) -> DataFrame:
    """Group rows of equal text, white space aside, and choose the row of each group that stays.

    Texts are equal when identical after deletion of ASCII white space (space, tab to carriage return). Of equal texts
    the row with the most code points in the original stays, then the smallest id.

    Columns: ``doc_id``, ``keep_id`` (id of the row that stays), ``group_size``, ``kept``, ``text_sha256`` (of the
    normalised text). One row per input row.

    Defined cases: a null text counts as empty and empty texts form one group; a null id sorts after all other ids; rows
    repeated with the same id are members of one group and all have ``kept`` true if that id stays; ids may be of any
    type that sorts; an empty table gives an empty result; other columns of ``docs`` are ignored, whatever their names.
    """
    spark, polynomial = docs.sparkSession, polynomial or Polynomial()
    tune(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")).select(
        "doc_id", F.length("_text").cast("long").alias("n_points"), F.translate("_text", ASCII_SPACE, "").alias("norm")
    )
    base = base.withColumns({"fp": fingerprint_column(F.col("norm"), polynomial), "sha": F.sha2(F.col("norm").cast("binary"), 256), "row": F.monotonically_increasing_id()})
    # Written once: the fingerprints and normal texts are not made again, and the rows keep their numbers.
    rows = written(spark, base, "fingerprints")
    total = rows.count()
    rank = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d"))
    groups = written(spark, rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("head"), F.min("sha").alias("sha")), "groups")
    spread = F.xxhash64("row")

    bitmap = written(spark, _bitmap(groups), "bitmap")

    # A fingerprint outside the bitmap has one row, which is its own group.
    alone = _parted(groups, bitmap, False).select(
        F.col("head.c").alias("doc_id"), F.col("head.c").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    # All other rows carry their texts to their fingerprint's partition, once, and few single rows with them. A hot
    # fingerprint has several partitions: its representative goes to each of them, ahead of the others.
    hot = groups.where(F.col("n") > max(total // HOT, 1000)).select("fp", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("_salts"), F.col("head.d").alias("_head"))
    members = _parted(rows, bitmap, True).join(F.broadcast(hot), "fp", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    members = members.withColumns({"is_head": F.coalesce(F.col("_head") == F.col("row"), F.lit(False)), "_own": F.pmod(spread, F.col("_salts")).cast("int")})
    members = members.withColumn("salt", F.explode(F.when(F.col("is_head"), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array("_own"))))
    members = members.select("doc_id", "n_points", "sha", "fp", "row", "salt", "norm", (~F.col("is_head")).alias("tail"), (F.col("salt") == F.col("_own")).alias("own"))
    compared = members.repartition("fp", "salt").sortWithinPartitions("fp", "salt", "tail")
    checked = written(spark, compared.mapInArrow(lean(_compare), f"doc_id {kind}, n_points long, sha string, fp long, row long, same boolean"), "compared")
    forget(spark, rows)
    # A row that differs from its representative (a collision) joins the rows with its own digest instead.
    checked = checked.withColumn("sub", F.when(F.col("same"), F.lit("")).otherwise(F.col("sha")))
    final = checked.groupBy("fp", "sub").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("head"))
    together = joined_by_size(checked, final, ["fp", "sub"], "group_size", total, spread)
    kept = (F.col("head.a") == -F.col("n_points")) & F.col("head.c").eqNullSafe(F.col("doc_id"))
    return alone.unionByName(together.select("doc_id", F.col("head.c").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256")))


__all__ = ["Polynomial", "exact_dedup", "fingerprint_column", "same_bytes"]
