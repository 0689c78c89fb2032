"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are statistics of the whole text. Trees are grown level by level on quantile bins with the logistic loss, and
flattened into arrays (feature, threshold, children, value) that numpy traverses for all rows at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relomap.llm.common import flat_bytes, hashed_share, lean, text_of, tune

# Classes of bytes; shares of a text's bytes are features.
_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "bar", "loud", "quote", "bracket", "symbol", "dash", "high", "control")
_MEMBERS = {
    "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "space": b" \t\x0b\x0c", "newline": b"\n\r", "stop": b".", "comma": b",;:",
    "bar": b"|", "loud": b"!?", "quote": b"'\"`", "bracket": b"()[]{}<>", "symbol": b"#$%&*+=@^~\\", "dash": b"-_/", "high": bytes(range(128, 256)),
}
_TABLE = np.full(256, len(_CLASSES) - 1, dtype=np.uint8)
for _i, _name in enumerate(_CLASSES[:-1]):
    _TABLE[list(_MEMBERS[_name])] = _i
FEATURES = (*(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "log_lines", "word_length", "longest_word", "distinct_words", "top_word", "capital_words", "shout_words", "short_words", "odd_ends", "line_words", "distinct_lines")


def statistics(column: pa.Array) -> np.ndarray:
    """Features of each text (null: empty) as float32 rows, in the order of ``FEATURES``."""
    flat, offsets = flat_bytes(column)
    n, k = len(column), len(_CLASSES)
    out = np.zeros((n, len(FEATURES)), dtype=np.float32)
    lengths = np.diff(offsets)
    for first in range(0, n, 512):  # the class of every byte, by groups of texts
        last = min(first + 512, n)
        part = _TABLE[flat[offsets[first] : offsets[last]]].astype(np.int64)
        part += np.repeat(np.arange(last - first) * k, lengths[first:last])
        counts = np.bincount(part, minlength=(last - first) * k).reshape(-1, k)
        out[first:last, :k] = counts / np.maximum(lengths[first:last, None], 1)
    out[:, k] = np.log1p(lengths)
    for i, text in enumerate(column.to_pylist()):
        words = (text or "").split()
        if not words:
            continue
        m, counts, lines = len(words), Counter(words), text.split("\n")
        caps = sum(c for w, c in counts.items() if w[0].isupper())
        shout = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
        short = sum(c for w, c in counts.items() if len(w) <= 3)
        odd = sum(c for w, c in counts.items() if not (w[-1].isalnum() or w[-1] in ".,"))
        out[i, k + 1 :] = (
            np.log1p(m), np.log1p(len(lines)), sum(map(len, words)) / m, np.log1p(max(map(len, counts))), len(counts) / m, max(counts.values()) / m,
            caps / m, shout / m, short / m, odd / m, m / len(lines), len(set(lines)) / len(lines),
        )
    return out


@dataclass(frozen=True)
class QualityOptions:
    trees: int = 120
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    l2: float = 1.0
    #: Least sum of hessians in a leaf.
    least: float = 3.0
    #: Labelled rows that are learned from, about so many at most and by hashed id: the bound on the driver's sample.
    max_rows: int = 20_000
    #: A row is predicted 1 from this score on.
    threshold: float = 0.7


@dataclass
class BoostedTrees:
    """Trees as flat arrays; ``roots`` are the trees' first nodes, a leaf is its own child."""

    prior: float = 0.0
    depth: int = 0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float64))

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out, at = np.full(len(rows), self.prior), np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root, dtype=np.int32)
            for _ in range(self.depth):
                node = np.where(rows[at, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(rows), -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, o: QualityOptions) -> BoostedTrees:
    """Fit trees on feature rows and 0/1 labels. Without both labels the model is the smoothed share of ones."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = BoostedTrees(prior=float(np.log(share / (1 - share))), depth=o.depth)
    if len(np.unique(labels)) < 2:
        return model
    n, m = rows.shape
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, o.bins + 1)[1:-1]).astype(np.float32)) for j in range(m)]
    binned = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    keys = binned + np.arange(m) * o.bins
    margin = np.full(n, model.prior)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(feature)
        for store, x in ((feature, 0), (threshold, 0.0), (left, i), (right, i), (value, v)):
            store.append(x)
        return i

    for _ in range(o.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - labels, p * (1 - p)
        root = node(-o.rate * g.sum() / (h.sum() + o.l2))
        roots.append(root)
        where = np.full(n, root)
        level = [root]
        for _ in range(o.depth):
            spot = {k: i for i, k in enumerate(level)}
            local = np.array([spot.get(k, -1) for k in range(level[0], level[-1] + 1)])[np.clip(where - level[0], 0, level[-1] - level[0])]
            live = np.flatnonzero((where >= level[0]) & (where <= level[-1]) & (local >= 0))
            flat = (local[live, None] * (m * o.bins) + keys[live]).ravel()
            size = len(level) * m * o.bins
            gs = np.bincount(flat, np.repeat(g[live], m), size).reshape(len(level), m, o.bins)
            hs = np.bincount(flat, np.repeat(h[live], m), size).reshape(len(level), m, o.bins)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + o.l2) + (gt - gl) ** 2 / (ht - hl + o.l2) - gt**2 / (ht + o.l2)
            gain[(hl < o.least) | (ht - hl < o.least)] = -np.inf
            fresh = []
            for i, k in enumerate(level):
                j, b = divmod(int(gain[i].argmax()), o.bins)
                if not gain[i, j, b] > 1e-9 or b >= len(edges[j]):
                    continue
                a, c = gl[i, j, b], hl[i, j, b]
                left[k] = node(-o.rate * a / (c + o.l2))
                right[k] = node(-o.rate * (gt[i, 0, 0] - a) / (ht[i, 0, 0] - c + o.l2))
                feature[k], threshold[k] = j, float(edges[j][b])
                mine = live[where[live] == k]
                where[mine] = np.where(binned[mine, j] <= b, left[k], right[k])
                fresh += [left[k], right[k]]
            if not fresh:
                break
            level = fresh
        margin += np.array(value)[where]
    model.roots, model.feature, model.left, model.right = (np.array(x, dtype=np.int32) for x in (roots, feature, left, right))
    model.threshold, model.value = np.array(threshold, dtype=np.float32), np.array(value)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, options: QualityOptions | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> BoostedTrees:
    """Fit on the texts of about ``max_rows`` labelled rows at most, of those where ``learn`` (over labels) holds.

    Rows whose id, text or label is null are not learned from; an id with several labels or texts counts once for each.
    """
    o = options or QualityOptions()
    tune(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & learn).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    chosen = chosen.where(hashed_share(F.col("_id"), o.max_rows, chosen.count()))  # bounded, so it may be broadcast
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(rows), type=pa.list_(pa.float32()))], ["id", "label", "row"])

    got = texts.select("_text", F.col("_id").cast("string"), "_label").mapInArrow(lean(measure), "id string, label int, row array<float>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    rows = np.array(got.column("row").to_pylist(), dtype=np.float32).reshape(-1, len(FEATURES))
    return fit(rows, got.column("label").to_numpy().astype(np.float64), o)


def score_quality(docs: DataFrame, model: BoostedTrees, options: QualityOptions | None = None, text_col: str = "text", score_col: str = "quality_score", predicted_col: str = "quality_predicted") -> DataFrame:
    """Score every whole text: the columns of ``docs`` and ``quality_score`` (0 to 1) and ``quality_predicted`` (0 or 1), or
    what these are to be named.

    Defined cases: a null or empty text has all-zero statistics and is scored by them; texts of any length are measured
    whole; rows with null or repeated ids are rows as any other; an empty table gives an empty result. Columns of
    ``docs`` named as the two new ones are replaced.
    """
    tune(docs.sparkSession)
    shared, limit = docs.sparkSession.sparkContext.broadcast(model), (options or QualityOptions()).threshold

    @F.arrow_udf("double")  # type: ignore[call-overload]
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(statistics(texts)))

    return docs.withColumn(score_col, score(text_of(text_col))).withColumn(predicted_col, (F.col(score_col) >= limit).cast("int"))
