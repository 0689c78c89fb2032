"""Line dedup by a segment-partition edit join.

Lines are trimmed of ASCII white space, and equal ones become one. Distinct lines within ``edits`` edits of each other
are linked: each line is split into ``edits + 1`` segments, lines that share a segment signature with a length-aware
probe are compared by banded bit-parallel edit distance, and linked lines, with those linked to them, form a class. Of a
class only the first occurrence stays, by document id and line number.

With ``words_per_edit`` lines are linked by word edits as well, whose bound grows with the line: the same join runs over
words in place of code points, with a partition for each number of edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relomap.llm.common import flat_bytes, joined_by_size, lean, runs_of, text_of, tune, written
from relomap.llm.components import Forest, components
from relomap.llm.editjoin import Signer, WordSigner, within, within_growing, word_hashes
from relomap.tables import forget_since, tables_so_far

#: ASCII white space but the line feed, which ends lines.
_BLANK = " \t\x0b\x0c\r"
#: A meeting row has up to 63 bits of its line's hash; the sign bit is set in index rows, which so come first.
_WHO, _INDEX = (1 << 63) - 1, -(1 << 63)
#: Signatures are dealt packed: so many bytes of the key, beside those bits of it that name the bucket, and of the line's
#: hash. A key that two different ones become costs a comparison; two near lines whose hashes are equal would not meet.
_KEY_BYTES, _LINE_BYTES = 5, 6
_KEY, _LINE = (1 << 8 * _KEY_BYTES) - 1, (1 << 8 * _LINE_BYTES) - 1
#: Signatures that a task packs together; signatures of a bucket, about, and the fewest bits of its number; signatures of a
#: bucket that are looked at together.
PACK, PER_BUCKET, LEAST_BITS, HELD = 1 << 20, 500_000, 10, 1 << 21
#: Longs of a block of the bitmap of lines that met others, and the most blocks (32 MB in all).
BLOCK_LONGS, MOST_BLOCKS = 1024, 4096


@dataclass(frozen=True)
class LineOptions:
    edits: int = 2
    #: Lines of fewer code points, trimmed, are too short for edits: two of a word of five make another word. If not empty,
    #: they form classes of equal lines.
    min_chars: int = 20
    #: Lines of n words or more are also linked within one word edit, those of 2n within two and so on; 0 for none.
    words_per_edit: int = 30
    #: Where the growth of the word edits ends: signatures of a line grow with the square of its edits.
    most_word_edits: int = 12
    #: Rows of a signature that one task compares; more are cut into blocks, and all pairs of blocks compared.
    block: int = 1024


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), dtype="<u4"), np.cumsum([0, *(len(r) >> 2 for r in raw)])


def _points_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``_code_points`` of a column, by one conversion of all its texts."""
    flat, offsets = flat_bytes(column)
    if not len(flat) or int(flat.max()) < 128:
        return flat.astype(np.uint32), offsets
    begins = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum((flat & 0xC0) != 0x80)])  # code points begin in all other bytes
    return np.frombuffer(flat.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4"), begins[offsets]


def _packed(key: np.ndarray, who: np.ndarray, index: np.ndarray, bits: int) -> pa.RecordBatch:
    """Signatures as a row for each bucket and role: ``bucket``, ``probe``, ``rows`` (byte by byte, the keys ascending)."""
    key = key.view(np.uint64)
    place = (key >> np.uint64(64 - bits)) << np.uint64(1) | (~index).astype(np.uint64)
    order = np.argsort(place << np.uint64(8 * _KEY_BYTES) | key & np.uint64(_KEY))
    place, key, who = place[order], key[order], who[order].view(np.uint64)
    planes = np.concatenate([key.view(np.uint8).reshape(-1, 8)[:, _KEY_BYTES - 1 :: -1].T, who.view(np.uint8).reshape(-1, 8)[:, :_LINE_BYTES].T])
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, dtype=np.int64)
    rows = [planes[:, a:b].tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(place)], strict=bool(len(starts)))]
    own = place[starts]
    return pa.RecordBatch.from_arrays([pa.array((own >> np.uint64(1)).astype(np.int32)), pa.array(own & np.uint64(1) == 1), pa.array(rows, type=pa.binary())], ["bucket", "probe", "rows"])


def _unpacked(bucket: int, index: list[bytes], probes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key and who of packed rows of one bucket."""
    both = _KEY_BYTES + _LINE_BYTES
    planes = np.concatenate([np.frombuffer(r, dtype=np.uint8).reshape(both, -1) for r in (*index, *probes)], axis=1)
    key, who = (np.zeros((planes.shape[1], 8), dtype=np.uint8) for _ in range(2))
    key[:, _KEY_BYTES - 1 :: -1], who[:, :_LINE_BYTES] = planes[:_KEY_BYTES].T, planes[_KEY_BYTES:].T
    key, who = (x.view(np.int64).ravel() for x in (key, who))
    who[: sum(map(len, index)) // both] |= _INDEX
    return key | (bucket << 8 * _KEY_BYTES), who


def _sign(o: LineOptions, bits: int):
    """Packed signatures of lines; the lowest bit of a key tells those of words (1) from those of code points."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen, ready, size = Signer(o.edits), set(), [], 0
        by_words = WordSigner(o.words_per_edit, o.most_word_edits) if o.words_per_edit else None
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy() for i in (1, 2))
            if len(seen) > 200_000:
                seen.clear()
            fresh = []
            for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):  # a task signs copies of a line once
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            lines = _points_of(batch.column(0).take(pa.array(fresh, type=pa.int64())))
            number, index, key = signer.sign(*lines)
            key &= ~1
            if by_words:
                more = by_words.sign(*lines)
                number, index, key = (np.concatenate(c) for c in zip((number, index, key), (*more[:2], more[2] | 1), strict=True))
            ready.append((key, h1[np.array(fresh, dtype=np.int64)[number]] & _LINE, index))
            size += len(key)
            if size >= PACK:
                yield _packed(*(np.concatenate(c) for c in zip(*ready, strict=True)), bits)
                ready, size = [], 0
        if size:
            yield _packed(*(np.concatenate(c) for c in zip(*ready, strict=True)), bits)

    return sign


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, who), those of keys that have an index row and rows of two lines or more.

    A key's index rows are not in a later batch than its first probe. What is held between batches, for each key with an
    index row, is one row where the key's others are given back already, else those of its one line: two at most.
    """
    key, who, given = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        k, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        given = np.concatenate([given, np.zeros(len(k), dtype=bool)])
        key, who = np.concatenate([key, k]), np.concatenate([who, w])
        order = np.lexsort((~given, who, key))
        key, who, given = key[order], who[order], given[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])])
        key, who, given = key[fresh], who[fresh], given[fresh]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        starts, line = np.flatnonzero(first), who & _WHO
        sizes = np.diff(np.append(starts, len(key)))
        indexed = who[starts] < 0
        good = indexed & (np.logical_or.reduceat(given, starts) | (np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)))
        out = np.repeat(good, sizes) & ~given
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(who[out])], ["key", "who"])
        held = np.repeat(indexed, sizes) & (first | ~np.repeat(good, sizes))
        key, who, given = key[held], who[held], np.repeat(good, sizes)[held]


def _meet_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_meet`` for packed rows sorted by (bucket, probe), bucket by bucket; large buckets some rows at a time."""

    def parts(bucket: int, rows: Iterator[tuple[bool, bytes]]) -> Iterator[pa.RecordBatch]:
        index, probes, size, whole = [], [], 0, True
        for probe, packed in rows:
            if size and size + len(packed) > HELD * (_KEY_BYTES + _LINE_BYTES):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, _unpacked(bucket, index, probes))), ["key", "who"])
                index, probes, size, whole = [], [], 0, False
            (probes if probe else index).append(packed)
            size += len(packed)
        key, who = _unpacked(bucket, index, probes)
        if whole:  # most keys occur once, and are not worth sorting
            spot = key >> 1 & ((1 << 22) - 1)
            some = np.flatnonzero(np.bincount(spot, minlength=1 << 22)[spot] > 1)
            key, who = key[some], who[some]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who)], ["key", "who"])

    rows = ((b, p, r) for batch in batches for b, p, r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
    for bucket, own in groupby(rows, itemgetter(0)):
        yield from _meet(parts(bucket, ((p, r) for _, p, r in own)))


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``block``, ``spot`` (a bit's number in the block) sorted by block to a row for each block: ``of``, ``bits``."""
    for run in runs_of(batches, "block"):
        grid = np.zeros(BLOCK_LONGS * 64, dtype=np.uint8)
        grid[run.column("spot").to_numpy()] = 1
        bits = np.packbits(grid, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays([run.column("block").combine_chunks()[:1], pa.array([bits], type=pa.list_(pa.int64()))], ["of", "bits"])


def _known(lines: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """Rows of ``lines`` whose ``line_hash`` may be among those ``wanted`` (at most ``most``): all that are and few others.

    By a broadcast bitmap of some 16 bits for each one, up to ``MOST_BLOCKS``; the fuller it is, the more others stay.
    """
    count = 1
    while count < MOST_BLOCKS and count * BLOCK_LONGS * 64 < 16 * most:
        count *= 2
    block, spot = F.col("line_hash").bitwiseAND(count - 1), F.shiftright("line_hash", 16).bitwiseAND(BLOCK_LONGS * 64 - 1)
    marked = wanted.select(block.alias("block"), spot.alias("spot")).repartition("block").sortWithinPartitions("block")
    bitmap = marked.mapInArrow(lean(_bitmap), "of long, bits array<long>")
    word = F.get("bits", F.shiftright(spot, 6).cast("int"))
    bit = F.call_function("shiftright", word, spot.bitwiseAND(63).cast("int")).bitwiseAND(1)
    return lines.join(F.broadcast(bitmap), (block == F.col("of")) & (bit == 1), "left_semi")


def _verify(o: LineOptions):
    def units(texts: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        lines = _code_points(texts)
        return word_hashes(*lines) if words else lines

    def alike(lines: tuple[np.ndarray, np.ndarray], a: list[int], b: list[int], words: bool) -> list[bool]:
        pairs = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        return (within_growing(*lines, *pairs, o.words_per_edit, o.most_word_edits) if words else within(*lines, *pairs, o.edits)).tolist()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        left: list[int] = []
        right: list[int] = []
        by_words: list[bool] = []
        spot: dict[int, int] = {}

        def flush() -> pa.RecordBatch:
            forest, found = Forest(len(texts)), []
            for words in (False, True):
                # A pair once, under however many keys it meets, and not if it is linked already.
                pairs = dict.fromkeys((x, y) for x, y, kind in zip(left, right, by_words, strict=True) if kind == words)
                pairs = [(x, y) for x, y in pairs if forest.root(x) != forest.root(y)]
                if pairs:
                    a, b = map(list, zip(*pairs, strict=True))
                    found += [(x, y) for x, y, near in zip(a, b, alike(units(texts, words), a, b, words), strict=True) if near and forest.join(x, y)]
            return out(found)

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(list(spot), dtype=np.int64)[np.array(found, dtype=np.int64).reshape(-1, 2)]
            texts.clear(), left.clear(), right.clear(), by_words.clear(), spot.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        def place(node: int, text: str) -> int:
            if node not in spot:
                spot[node] = len(texts)
                texts.append(text)
            return spot[node]

        for run in runs_of(batches, "bucket"):
            node, probe, side = (run.column(n).to_numpy(zero_copy_only=False) for n in ("node", "probe", "side"))
            text, words = run.column("text").to_pylist(), run.column("words")[0].as_py()
            index, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
            order = np.concatenate([index, probes]).tolist()  # an index row meets later index rows and all probes
            if len(index) * len(order) <= 2000:
                for at, i in enumerate(index.tolist(), 1):
                    for j in order[at:]:
                        if node[i] != node[j] and (side[i] == 2 or side[i] != side[j]):
                            left.append(place(node[i], text[i]))
                            right.append(place(node[j], text[j]))
                            by_words.append(words)
                if len(left) > 20_000 or sum(map(len, texts[-50:])) > 1 << 22:
                    yield flush()
                continue
            yield flush()
            spots = [place(n, t) for n, t in zip(node.tolist(), text, strict=True)]
            lines, forest, found = units(texts, words), Forest(len(texts)), []
            for at, i in enumerate(index.tolist(), 1):  # some index rows at a time, with rows that are not linked to them yet
                root = forest.root(spots[i])
                others = dict.fromkeys(spots[j] for j in order[at:] if side[i] == 2 or side[i] != side[j])
                others = [x for x in others if forest.root(x) != root]
                left += [spots[i]] * len(others)
                right += others
                if len(left) > 8000 or at == len(index):
                    found += [(x, y) for x, y, near in zip(left, right, alike(lines, left, right, words), strict=True) if near and forest.join(x, y)]
                    left.clear(), right.clear()
            yield out(found)
        yield flush()

    return verify


def _lines(docs: DataFrame, id_col: str, text_col: str, extra: list[Column] = ()) -> DataFrame:
    """A row per line: ``doc_id``, ``line_no`` from 0, the trimmed ``line`` and its two hashes."""
    split = docs.select(F.col(id_col).alias("doc_id"), *extra, F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("line_no", "_raw"))
    line = F.btrim("_raw", F.lit(_BLANK))
    names = [c for c in split.columns if c != "_raw"]
    return split.select(*names, line.alias("line")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "n_chars": F.length("line")})


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: LineOptions | None = None) -> DataFrame:
    """One row per distinct line that is not empty: ``h1``, ``h2`` (its identity), ``n`` (its occurrences), ``first`` (doc_id
    and line_no of its class's first occurrence), ``class_size`` (occurrences of the class's lines)."""
    spark, o = docs.sparkSession, options or LineOptions()
    tune(spark)
    mark = tables_so_far()
    judged = _lines(docs, id_col, text_col).where("n_chars > 0")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")
    firsts = written(spark, judged.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")), "lines")

    # Some 16 signatures a line; they are dealt in buckets of keys, packed, and sorted where they arrive.
    bits = max(LEAST_BITS, (16 * (firsts.agg(F.sum("n")).first()[0] or 0) // PER_BUCKET).bit_length())
    signed = judged.where(F.col("n_chars") >= o.min_chars).select("line", "h1", "h2").mapInArrow(lean(_sign(o, bits)), "bucket int, probe boolean, rows binary")
    met = signed.repartition("bucket").sortWithinPartitions("bucket", "probe").mapInArrow(lean(_meet_packed), "key long, who long")
    # Large buckets are worked on in parts, and may give back a row for several copies of a line.
    met = met.select("key", F.col("who").bitwiseAND(F.lit(_WHO)).alias("line_hash"), (F.col("who") >= 0).alias("probe")).distinct()
    met = written(spark, met, "met")
    # The lines that meet others grow with the input, so this is a shuffle join at every size, of lines that a bitmap picks.
    wanted = written(spark, met.select("line_hash").distinct(), "wanted")
    hashed = judged.select("h1", "h2", "line", F.col("h1").bitwiseAND(F.lit(_LINE)).alias("line_hash"))
    texts = _known(hashed, wanted, wanted.count()).join(wanted.hint("merge"), "line_hash", "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("text"))
    texts = written(spark, texts.withColumns({"node": F.monotonically_increasing_id(), "line_hash": F.col("h1").bitwiseAND(F.lit(_LINE))}), "candidates")

    # A key's rows are compared in one task, or, if many, in blocks: each row goes to the block pairs that hold its block.
    blocks = F.ceil(F.col("rows") / o.block).cast("int")
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > o.block).select("key", blocks.alias("blocks"))
    dealt = met.join(sizes, "key", "left").join(texts, "line_hash").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.col("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # Side 0 or 1 tells the blocks of a pair apart, so that only rows of different ones are compared; 2 is a block with itself.
    side = F.when(low == high, 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    dealt = dealt.select(F.xxhash64("key", low, high).alias("bucket"), "node", "probe", side.alias("side"), (F.col("key").bitwiseAND(1) == 1).alias("words"), "text")
    edges = dealt.repartition("bucket").sortWithinPartitions("bucket", "node", "probe").mapInArrow(lean(_verify(o)), "a long, b long")
    linked = components(edges).join(texts.select("node", "h1", "h2"), "node").select("h1", "h2", "root")
    linked = written(spark, linked, "linked")
    whole = linked.join(firsts, ["h1", "h2"]).groupBy("root").agg(F.min("first").alias("class_first"), F.sum("n").alias("class_n"))
    classed = linked.join(whole, "root").drop("root")
    found = firsts.join(classed, ["h1", "h2"], "left").select("h1", "h2", "n", F.coalesce("class_first", "first").alias("first"), F.coalesce("class_n", "n").alias("class_size"))
    classes = written(spark, found, "line-classes")
    forget_since(spark, mark, classes)  # nothing else that was written here is read again
    return classes


def _with_classes(lines: DataFrame, classes: DataFrame, keep: bool) -> DataFrame:
    """Lines with what their classes say, by a join that a line of many occurrences does not slow; ``keep`` empty lines."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    return joined_by_size(lines, classes, ["h1", "h2"], "n", total, F.xxhash64("doc_id", "line_no"), F.col("n_chars") == 0 if keep else None)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: LineOptions | None = None) -> DataFrame:
    """One row per line of every text: ``doc_id``, ``line_no``, ``n_chars`` (trimmed), ``class_doc_id`` and
    ``class_line_no`` (where the line's class occurs first), ``class_size`` (its occurrences), ``kept``.

    Defined cases: a null text counts as empty and is one empty line; empty lines are classes of their own, with size 1,
    and stay; lines shorter than ``min_chars`` are linked with equal ones only; a null id sorts after all others; rows
    repeated with the same id have the same first occurrence, so all of them keep it; an empty table gives an empty
    result; other columns are ignored.
    """
    lines = _lines(docs, id_col, text_col).drop("line")
    found = _with_classes(lines, line_classes(docs, id_col, text_col, options), True)
    judged = F.col("n_chars") > 0
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.line_no") == F.col("line_no"))
    return found.select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.when(judged, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_doc_id"),
        F.when(judged, F.col("first.line_no")).otherwise(F.col("line_no")).cast("long").alias("class_line_no"),
        F.when(judged, F.col("class_size")).otherwise(1).cast("long").alias("class_size"),
        F.coalesce(~judged | first, F.lit(True)).alias("kept"),
    )


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: LineOptions | None = None) -> DataFrame:
    """The rows of ``docs`` with the repeated lines taken out of their texts; all columns as they were.

    A text without repeated lines is returned unchanged; of others the remaining lines, empty ones among them, are joined
    by line feeds. Rows equal in id and text are one document to this operator: both keep their first occurrences. A null
    text stays null; a null id sorts after all others; columns may have any names.
    """
    identity = [F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2")]
    texts = docs.where(F.col(text_col).isNotNull())
    lines = _lines(texts, id_col, text_col, identity).drop("line").where("n_chars > 0")
    found = _with_classes(lines, line_classes(docs, id_col, text_col, options), False)
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.line_no") == F.col("line_no"))
    drops = found.where(~first).groupBy("doc_id", "t1", "t2").agg(F.collect_set("line_no").alias("drops"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), text_col).alias("k2"))
    joined = whole.join(drops, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")), "left")
    lines_left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("drops", i))
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(lines_left, "\n"))
    return joined.select(*((text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
