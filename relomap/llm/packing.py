"""Packing token sequences by best-fit decreasing.

Texts are encoded, cut into full windows and a remainder, and the remainders are
packed by best-fit decreasing: longest first, each into the tightest open window. A segment tree indexed by residual
capacity finds that window. Lengths take at most ``window`` values, so the packing runs over a histogram of lengths:
pieces of equal length are placed together into windows of equal contents, which gives exactly the windows of the
one-by-one algorithm in time and memory that depend on the window and not on the corpus.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relomap.llm.common import lean, text_of, tune, written

#: Characters whose classes no Unicode version changes: Latin letters, digits, punctuation and ASCII white space.
_PLAIN = re.compile("[{}]*".format("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ((0x09, 0x0D), (0x20, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC)))))
#: Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as the tokenizers library gives them for a vocabulary file (no special tokens added).

    The merges of the file are run by the faster of two libraries, as ranked byte pairs, where that is known to give the
    same ids: the file's ids ascend in the order of its merges, and the text has only characters that both libraries
    class alike and no special token. All other texts go through the tokenizers library itself, and so do those that the
    faster one refuses for a very long run of white space.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.fast = None
        model, pre, alphabet = spec["model"], json.dumps(spec.get("pre_tokenizer")), byte_alphabet()
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        ids = [model["vocab"].get(m, -1) for m in merges]
        if model.get("type") == "BPE" and '"ByteLevel"' in pre and '"add_prefix_space": false' in pre and not spec.get("normalizer") and ids == sorted(set(ids)):
            ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special and all(c in alphabet for c in t)}
            fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            probe = "It's 12 probes,  of\n\n every kind!? \t\xe9t\xe9 'll"
            self.fast = fast if fast.encode_ordinary(probe) == self.tokenizer.encode(probe, add_special_tokens=False).ids else None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its pattern engine keeps a stack entry for each character of a run of white space
            return self.whole(text)


@dataclass(frozen=True)
class PackOptions:
    tokenizer: str = ""
    window: int = 2048
    #: Follows each document's ids.
    end_id: int = 1
    id_col: str = "doc_id"
    text_col: str = "text"


class SegmentTree:
    """Residual capacities that have open windows; finds the smallest one that is at least a given length."""

    def __init__(self, size: int) -> None:
        self.width = 1 << size.bit_length()
        self.any = bytearray(2 * self.width)

    def set(self, at: int, value: bool) -> None:
        at += self.width
        self.any[at] = value
        at >>= 1
        while at:
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest marked index from ``least`` on, or -1."""
        at = least + self.width
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return -1


def best_fit_decreasing(counts: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Best-fit decreasing over a histogram: ``counts[s]`` pieces of length ``s`` for s = 1 to ``window``.

    Returns placements and windows. A placement (length, first rank, pieces, first window, pieces per window, offset)
    says: of the pieces of that length those from ``first rank`` on go to consecutive windows, so many to a window, the
    first of a window at ``offset``. Windows are runs (first window, windows, tokens) of equal fill.
    """
    tree = SegmentTree(window + 1)
    open_: dict[int, list[tuple[int, int]]] = {}  # residual -> runs (first window, windows)
    placed: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def put(residual: int, first: int, n: int) -> None:
        if n:
            open_.setdefault(residual, []).append((first, n))
            tree.set(residual, True)

    for s in range(window, 0, -1):
        left, rank = int(counts[s]), 0
        while left:
            r = tree.tightest(s)
            if r < 0:
                per, need = window // s, -(-left // (window // s))
                put(window, made, need)
                made += need
                r = window
            first, n = open_[r].pop()
            if not open_[r]:
                del open_[r]
                tree.set(r, False)
            per = r // s  # the tightest window stays the tightest as it fills with pieces of one length
            full = min(n, left // per)
            if full:
                placed.append((s, rank, full * per, first, per, window - r))
                put(r - per * s, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if n and 0 < left < per:
                placed.append((s, rank, left, first, left, window - r))
                put(r - left * s, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(r, first, n)
    windows = sorted((first, n, window - r) for r, runs in open_.items() for first, n in runs)
    return placed, windows


def _cutter(options: PackOptions):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encode, step = Encoder(options.tokenizer), 4 * options.window
        end = np.array([options.end_id], dtype="<u4").tobytes()
        part, ranks = TaskContext.get().partitionId(), np.zeros(options.window + 1, dtype=np.int64)
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), {k: [] for k in ("row", "start", "length", "crc", "total", "rank")}
            for i, text in enumerate(texts):
                ids = encode(text).tobytes() + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    n = len(piece) >> 2
                    for k, v in zip(rows, (i, at >> 2, n, zlib.crc32(piece), len(ids) >> 2, ranks[n]), strict=True):
                        rows[k].append(v)
                    ranks[n] += 1
            take = pa.array(rows.pop("row"), type=pa.int64())
            longs = [pa.array(v, type=pa.int64()) for v in rows.values()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), *longs, pa.array(np.full(len(take), part, dtype=np.int32))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "part"],
            )

    return cut


def pack_documents(docs: DataFrame, options: PackOptions) -> DataFrame:
    """Pack the token ids of all rows into sequences of at most ``options.window`` tokens.

    A row's ids are those of its text and then ``end_id``. They are cut into full windows and one remainder, and the
    pieces are packed by best-fit decreasing over all rows. One row per piece: ``doc_id``, ``start`` (ids of the row
    before the piece), ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (gapless from 0 within
    the sequence), ``sequence_tokens``, ``padded_tokens`` (the window, or the tokens where they are a power of two).

    Defined cases: a null text counts as empty and has one piece, the end id; rows with null or repeated ids are packed
    as any other; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark, w = docs.sparkSession, options.window
    tune(spark)
    kind = docs.schema[options.id_col].dataType.simpleString()
    base = docs.select(F.col(options.id_col).alias("doc_id"), text_of(options.text_col).alias("text"))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, rank long, part int"
    pieces = written(spark, base.mapInArrow(lean(_cutter(options)), schema), "pieces")

    # A piece's rank among all of its length: its rank in its task, after the pieces of the tasks before.
    blocks = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    blocks = written(spark, blocks.select("length", "part", "n", F.coalesce(before, F.lit(0)).cast("long").alias("before")), "blocks")
    counts = np.zeros(w + 1, dtype=np.int64)
    for length, n in blocks.groupBy("length").agg(F.sum("n")).collect():  # at most one row per length
        counts[length] = n
    placed, windows = best_fit_decreasing(counts, w)
    fills = {first: (n, tokens) for first, n, tokens in windows}
    starts = np.array(sorted(fills), dtype=np.int64)
    runs: dict[int, list[tuple[int, ...]]] = {}
    for s, rank, n, first, per, offset in placed:
        done = 0
        while done < n:  # cut where the fill of the windows changes
            at = first + done // per
            run = int(starts[np.searchsorted(starts, at, side="right") - 1])
            size, tokens = fills[run]
            take = min(n - done, (run + size - at) * per)
            runs.setdefault(s, []).append((rank + done, take, at, per, offset, tokens))
            done += take
    # The plan has a bounded number of runs, whatever the corpus, and is looked up by rank within a length.
    plan = {s: np.array(sorted(rs), dtype=np.int64) for s, rs in runs.items()}
    ranked = pieces.join(blocks.drop("n"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    return _assign(ranked, plan, w, kind)


def _assign(ranked: DataFrame, plan: dict[int, np.ndarray], window: int, kind: str) -> DataFrame:
    shared = ranked.sparkSession.sparkContext.broadcast(plan)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n in ("length", "rank")}
            sequence, offset, tokens = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for s in np.unique(col["length"]):
                at, runs = np.flatnonzero(col["length"] == s), shared.value[int(s)]
                run = runs[np.searchsorted(runs[:, 0], col["rank"][at], side="right") - 1]
                i = col["rank"][at] - run[:, 0]
                sequence[at], offset[at], tokens[at] = run[:, 2] + i // run[:, 3], run[:, 4] + i % run[:, 3] * s, run[:, 5]
            padded = np.where((tokens & (tokens - 1)) == 0, tokens, window)
            own = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (sequence, offset, tokens, padded))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens"])

    return ranked.mapInArrow(lean(assign), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long")
