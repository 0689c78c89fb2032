"""N-gram Jaccard join by chosen paths.

Each distinct set of word n-grams gets a sketch of min-hash tokens. A run splits all sets by sampled tokens: at each node
of a path every token is sampled with chance ``1 / (threshold * tokens)`` by a hash of the path and the token, and sets
that share a sampled token meet in a child. Small nodes are compared by brute force over sketches, large ones are split
again, and runs are repeated until a pair at the threshold is met with the target recall. The chance to stay together
falls with each level, so from level ``depth`` on twice as many tokens are sampled: it then has a floor, whatever the
depth, and the runs are reckoned from that. What the runs link is a
candidate component; inside it all pairs are compared exactly, in blocks, so links are counted and never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relomap.llm.common import flat_bytes, lean, mix64, runs_of, text_of, tune, written
from relomap.llm.components import Forest, components

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of texts that are shingled together, unless one text is longer.
SLICE = 1 << 20


@dataclass(frozen=True)
class JoinOptions:
    words: int = 5
    threshold: float = 0.8
    #: Tokens of a sketch.
    tokens: int = 64
    #: Sketches with this share of equal tokens are candidates: four standard deviations below the threshold.
    candidate: float = 0.6
    recall: float = 0.999
    #: Levels of splitting at which a shared token is sampled with a mean of one; below them ``deep`` times as many are.
    depth: int = 3
    deep: float = 2.0
    #: Sets of a node that are compared by brute force.
    brute: int = 64
    #: Sets of a node that one task splits further; larger nodes are split by the cluster.
    local: int = 8192
    #: Levels that the cluster splits; what is larger even then is one candidate component.
    levels: int = 8
    #: Sets of a block of the exact comparison.
    block: int = 256
    seed: int = 11

    @property
    def runs(self) -> int:
        """Runs after which a pair at the threshold has met with the target recall, however deep its path goes."""
        met = 1.0
        for _ in range(200):  # sampled shared tokens are about Poisson, and this falls to its fixed point
            met = 1.0 - math.exp(-self.deep * met)
        for _ in range(self.depth):
            met = 1.0 - math.exp(-met)
        return math.ceil(math.log(1.0 - self.recall) / math.log(1.0 - met))


class Shingler:
    """Sets of hashed word n-grams. A text of fewer words has one n-gram, all its words; one without words has none."""

    def __init__(self, words: int) -> None:
        self.words = words
        self._power = self._inverse = np.ones(1, dtype=np.uint64)

    def sets(self, flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The sorted distinct n-gram hashes of each text."""
        out: list[np.ndarray] = []
        first, n = 0, len(offsets) - 1
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1
            last = min(max(last, first + 1), n)
            out += self._slice(flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last
        return out

    def _slice(self, flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        size = len(flat)
        if len(self._power) < size + 1:
            inverse = pow(_BASE, -1, 1 << 64)
            self._power = np.cumprod(np.full(size + 1, _BASE, dtype=np.uint64))
            self._inverse = np.cumprod(np.full(size + 1, inverse, dtype=np.uint64))
        inside = ~_SPACE[flat]
        edge = np.zeros(size + 1, dtype=bool)
        edge[offsets[:-1]] = True
        before = np.concatenate([[False], inside])
        starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
        after = np.append(inside[1:], False) & ~edge[1:]
        ends = np.flatnonzero(inside & ~after) + 1
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self._power[:size])])
        word = mix64((sums[ends] - sums[starts]) * self._inverse[starts])
        own = np.searchsorted(starts, offsets)  # words of text i: own[i] to own[i + 1]
        k = self.words
        gram = np.zeros(max(0, len(word) - k + 1), dtype=np.uint64)
        for j in range(k):
            gram = gram * np.uint64(0xD6E8FEB86659FD93) + word[j : j + len(gram)]
        gram = mix64(gram + np.uint64(k))
        out = []
        for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(gram[a : b - k + 1]))
            elif b > a:
                h = np.zeros(1, dtype=np.uint64)
                for w in word[a:b]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + w
                out.append(mix64(h + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def sketches(sets: list[np.ndarray], tokens: int, seed: int) -> np.ndarray:
    """Min-hash tokens of each set as uint32 rows; zero for empty sets."""
    out = np.zeros((len(sets), tokens), dtype=np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return out
    rng = np.random.default_rng(seed)
    mult, add = rng.integers(0, 1 << 32, (2, tokens), dtype=np.uint64).astype(np.uint32)
    mult |= np.uint32(1)
    at, block = 0, 1 << 18
    while at < len(some):  # groups of sets of bounded size
        upto, held = at, 0
        while upto < len(some) and (upto == at or held + len(sets[some[upto]]) <= block):
            held += len(sets[some[upto]])
            upto += 1
        part = some[at:upto]
        flat = (np.concatenate([sets[i] for i in part]) >> np.uint64(32)).astype(np.uint32)
        heads = np.cumsum([0, *(len(sets[i]) for i in part[:-1])])
        for j in range(tokens):
            x = flat * mult[j] + add[j]
            x ^= x >> np.uint32(16)
            out[part, j] = np.minimum.reduceat(x * np.uint32(0x45D9F3B), heads)
        at = upto
    return out


def _measure(o: JoinOptions):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(o.words)
        for batch in batches:
            sets = shingler.sets(*flat_bytes(batch.column(1)))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            s1 = np.array([int(mix64(s).sum()) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            s2 = np.array([int(mix64(s ^ np.uint64(_BASE)).sum()) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            rows = [r.tobytes() for r in sketches(sets, o.tokens, o.seed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (s1, s2, n)), pa.array(rows, type=pa.binary()), batch.column(2), batch.column(3)], ["doc_id", "s1", "s2", "n", "sketch", "t1", "t2"])

    return measure


def sampled(sketch: np.ndarray, path: np.ndarray, o: JoinOptions, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child paths of the tokens that are sampled at the nodes ``path`` of each row, which are at ``level``."""
    share = (1.0 if level < o.depth else o.deep) / (o.threshold * o.tokens)
    token = sketch.astype(np.uint64) | (np.arange(sketch.shape[1], dtype=np.uint64) << np.uint64(32))
    h = mix64(token ^ path[:, None].view(np.uint64))
    rows, j = np.nonzero(h < np.uint64(int((1 << 64) * share)))
    return rows, mix64(h[rows, j] + np.uint64(1)).view(np.int64)


def _split(o: JoinOptions, level: int):
    """Rows (node, sketch, path) to rows (path, node) of their children; at level 0, the roots of all runs."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = [np.int64(o.seed * 1000 + r) for r in range(o.runs)]
        for batch in batches:
            node = batch.column(0).to_numpy()
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u4").reshape(-1, o.tokens)
            for path in [batch.column(2).to_numpy()] if level else [np.full(len(node), r) for r in roots]:
                rows, child = sampled(sketch, path, o, level)
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(node[rows])], ["path", "node"])

    return split


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (path, node), those of paths with several nodes."""
    held, key, opened = None, None, False
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        path, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.concatenate([[True], (path[1:] != path[:-1]) | (node[1:] != node[:-1])])
        batch, path = batch.filter(pa.array(fresh)), path[fresh]
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        sizes = np.diff(np.append(starts, len(path)))
        good = sizes > 1
        if held is None and path[0] == key and opened:
            good[0] = True
        key, opened, held = path[-1], bool(good[-1]), None
        if not opened:
            held = batch.slice(int(starts[-1]))
        out = batch.filter(pa.array(np.repeat(good, sizes)))
        if out.num_rows:
            yield out


def linked(sketch: np.ndarray, path: np.int64, o: JoinOptions, level: int = 0) -> list[tuple[int, int]]:
    """Spanning links of the candidate pairs that splitting finds among the rows of one node, which is at ``level``."""
    forest, out = Forest(len(sketch)), []
    least = math.ceil(o.candidate * o.tokens)

    known = np.arange(len(sketch))

    def brute(rows: np.ndarray) -> None:
        if len(rows) <= 24:  # most nodes: all pairs in one step
            own = sketch[rows]
            near = (own[:, None, :] == own[None, :, :]).sum(axis=2) >= least
            for x, y in np.argwhere(np.triu(near, 1)).tolist():
                if forest.join(int(rows[x]), int(rows[y])):
                    out.append((int(rows[x]), int(rows[y])))
            return
        for i in range(0, len(rows), 64):
            left = rows[i : i + 64]
            for j in range(i, len(rows), 256):
                right = rows[j : j + 256]
                both = np.concatenate([left, right])
                known[both] = [forest.root(x) for x in both.tolist()]
                if (known[both] == known[both[0]]).all():  # nothing left to join
                    continue
                same = np.zeros((len(left), len(right)), dtype=np.int16)
                for k in range(o.tokens):
                    same += sketch[left, k][:, None] == sketch[right, k][None, :]
                out.extend(forest.span(same >= least, left, right, known))

    def alike(rows: np.ndarray) -> bool:
        """Whether most rows are near the others, so that splitting would not part them."""
        some = rows[:: max(1, len(rows) // 40)][:40]
        return float((sketch[some][:, None, :] == sketch[some][None, :, :]).mean()) > o.candidate

    todo = [(np.arange(len(sketch)), path, level)]
    while todo:
        rows, at, depth = todo.pop()
        if len(rows) <= o.brute or depth >= level + o.levels or (len(rows) <= 4096 and alike(rows)):
            brute(rows)
            continue
        pick, child = sampled(sketch[rows], np.full(len(rows), at), o, depth)
        order = np.argsort(child, kind="stable")
        pick, child = pick[order], child[order]
        cuts = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                todo.append((rows[np.unique(pick[a:b])], child[a], depth + 1))
    return out


def _link(o: JoinOptions, level: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for run in runs_of(batches, "path"):
            node = run.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(run.column("sketch").to_pylist()), dtype="<u4").reshape(-1, o.tokens)
            for x, y in linked(sketch, run.column("path")[0].as_py(), o, level):
                a.append(node[x])
                b.append(node[y])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], ["a", "b"])

    return link


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, left by right, as a product of their incidence over shared elements."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(shared):
        return out
    rows_a, rows_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))

    def spots(flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        ok = shared[at] == flat
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], rows[ok][order]

    (at_a, rows_a), (at_b, rows_b) = spots(a, rows_a), spots(b, rows_b)
    for c in range(0, len(shared), 8192):
        width = min(8192, len(shared) - c)
        grids = []
        for at, rows, n in ((at_a, rows_a, len(left)), (at_b, rows_b, len(right))):
            part = slice(*np.searchsorted(at, [c, c + width]))
            grid = np.zeros((n, width), dtype=np.float32)
            grid[rows[part], at[part] - c] = 1.0
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def _count(o: JoinOptions):
    """Runs of one pair of blocks to rows (node, null, links, set links) and spanning links (a, b, null, null)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int | None, int | None, int | None]] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], ["a", "b", "links", "sets"])

        for run in runs_of(batches, "bucket"):
            node, side, copies = (run.column(n).to_numpy() for n in ("node", "side", "copies"))
            sets = [np.frombuffer(x, dtype="<u8") for x in run.column("grams").to_pylist()]
            size = np.array([len(s) for s in sets], dtype=np.float64)
            if side[0] == 2:
                left = right = np.arange(len(node))
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            common = overlaps([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
            near = common / (size[left][:, None] + size[right][None, :] - common) >= o.threshold
            near &= node[left][:, None] != node[right][None, :]
            for mine, others, grid in ((left, right, near), (right, left, near.T))[: 1 if side[0] == 2 else 2]:
                links, some = grid @ copies[others], grid.sum(axis=1)
                rows += [(int(node[m]), None, int(n), int(k)) for m, n, k in zip(mine, links, some, strict=True) if k]
            joined = Forest(len(node)).span(near, left, right, np.arange(len(node)))
            rows += [(int(node[p]), int(node[q]), None, None) for p, q in joined]
            if len(rows) > 50_000:
                yield out()
        yield out()

    return count


def _grams(words: int):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            found = [s.tobytes() for s in shingler.sets(*flat_bytes(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, type=pa.binary())], ["t1", "t2", "grams"])

    return grams


def candidate_links(sets: DataFrame, o: JoinOptions) -> DataFrame:
    """Candidate links ``a``, ``b`` between nodes of ``sets`` (``node``, ``sketch``), spanning within each path's node."""
    spark = sets.sparkSession
    rows = sets.select("node", "sketch").mapInArrow(lean(_split(o, 0)), "path long, node long")
    edges: DataFrame | None = None
    for level in range(o.levels + 1):
        met = written(spark, rows.repartition("path").sortWithinPartitions("path", "node").mapInArrow(lean(_several), "path long, node long"), "met")
        big = met.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("head")).where(F.col("rows") > o.local)
        big = written(spark, big, "large")
        more = big.limit(1).count() > 0
        small = met.join(big, "path", "left_anti") if more else met
        ready = small.join(sets.select("node", "sketch"), "node").select("path", "node", "sketch")
        found = ready.repartition("path").sortWithinPartitions("path", "node").mapInArrow(lean(_link(o, level + 1)), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if not more:
            break
        if level == o.levels:  # still as large after so many splits: one candidate component, for the exact stage to part
            edges = edges.unionByName(met.join(big, "path").select(F.col("head").alias("a"), F.col("node").alias("b")))
            break
        rows = met.join(big, "path", "left_semi").join(sets.select("node", "sketch"), "node").select("node", "sketch", "path").mapInArrow(lean(_split(o, level + 1)), "path long, node long")
    return edges


def _classed(docs: DataFrame, id_col: str, text_col: str, options: JoinOptions | None) -> DataFrame:
    """The columns of ``ngram_join``, and ``t1``, ``t2`` (hashes of the row's text) and ``class`` (null without n-grams)."""
    spark, o = docs.sparkSession, options or JoinOptions()
    tune(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    rows = written(spark, texts.mapInArrow(lean(_measure(o)), f"doc_id {kind}, s1 long, s2 long, n long, sketch binary, t1 long, t2 long"), "sets")
    key = ["s1", "s2", "n"]
    sets = rows.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.min(F.struct("t1", "t2")).alias("t"))
    sets = written(spark, sets.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")
    coarse = written(spark, components(candidate_links(sets, o)), "coarse")

    # Exact comparison inside the candidate components, one text for each distinct set, in blocks.
    members = coarse.join(sets.select("node", "copies", F.col("t.t1").alias("t1"), F.col("t.t2").alias("t2")), "node")
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / o.block).cast("int").alias("blocks"))
    members = written(spark, members.join(sizes, "root"), "members")
    # The members grow with the input, so this is a shuffle join at every size.
    wanted = texts.join(members.select("t1", "t2").hint("merge"), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    grams = wanted.select("text", "t1", "t2").mapInArrow(lean(_grams(o.words)), "t1 long, t2 long, grams binary")
    dealt = members.join(grams, ["t1", "t2"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    dealt = dealt.select(F.xxhash64("root", low, high).alias("bucket"), "node", "copies", side.alias("side"), "grams")
    exact = dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(lean(_count(o)), "a long, b long, links long, sets long")
    exact = written(spark, exact, "exact")
    counts = exact.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"), F.sum("sets").alias("set_links"))
    final = written(spark, components(exact.where("b IS NOT NULL").select("a", "b")), "final")
    classes = final.join(sets.select("node", "least", "copies"), "node").groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    known = final.join(classes, "root").join(counts, "node")
    found = sets.drop("sketch", "t").join(known, "node", "left")
    joined = rows.drop("sketch").join(found, key, "left")
    alone = F.col("copies").isNull()  # no n-grams
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("class_id", "least")).alias("class_id"),
        F.coalesce("class_size", "copies", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("set_links", F.lit(0)).cast("long").alias("n_set_links"),
        "t1",
        "t2",
        F.coalesce("root", "node").alias("class"),
    )


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: JoinOptions | None = None) -> DataFrame:
    """Join texts whose sets of word n-grams have a Jaccard similarity of at least the threshold.

    One row per input row: ``doc_id``, ``class_id`` (least id of all rows linked with it, directly or through others),
    ``class_size`` (rows of the class), ``n_links`` (other rows it is linked with, copies among them), ``n_set_links``
    (other distinct sets it is linked with). Words are runs of characters other than ASCII white space, as written.

    Defined cases: a text of fewer words than an n-gram has one n-gram, all its words; null, empty and blank texts have
    none, are linked with nothing and are classes of their own (``class_id`` is their id); a null id is passed over
    where another id of the class exists; repeated rows are copies of each other; an empty table gives an empty result;
    other columns are ignored.
    """
    return _classed(docs, id_col, text_col, options).drop("t1", "t2", "class")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: JoinOptions | None = None) -> DataFrame:
    """One row of each class of ``docs``, the one of the least id; all columns as they were.

    A row is known by its id and its text: rows equal in both are one document, of which one stays; rows of one id, or of
    none, with texts of different classes are different documents. Ids come before a null id, and of a class's texts
    under its least id the one with the least hashes stays. Of the rows without n-grams each document stays.
    """
    found = _classed(docs, id_col, text_col, options)
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")
    first = found.where("class IS NOT NULL").groupBy("class").agg(F.min(least).alias("row")).select("row.doc_id", "row.t1", "row.t2")
    stay = first.unionByName(found.where("class IS NULL").select("doc_id", "t1", "t2").distinct())
    keys = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("k1"), F.xxhash64(F.lit(1), text_of(text_col)).alias("k2"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
    kept = keys.join(stay, same, "left_semi").dropDuplicates(["id", "k1", "k2"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
