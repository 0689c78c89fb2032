"""Language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; transitions between the languages of neighbouring words are
learned with them, on word sequences that are spliced from texts of known languages, so that switches occur in training
as in code-switched text. Forward-backward gives each word a distribution over languages, and a text the mean of those
of its words.

The scan runs over all texts of a batch at once: texts are cut into blocks of words, the blocks' transfer matrices are
multiplied up step by step for all blocks in parallel, each text's blocks are chained, and a second pass fills in the
words. That is the exact forward-backward recursion, for texts of any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relomap.llm.common import hashed_share, lean, mix64, text_of, tune

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Words of a block of the scan.
BLOCK = 128
#: Distinct words whose scores a worker holds; a full table starts anew.
TABLE = 200_000
#: Scores are kept within this distance of a word's best one, so that single-precision products do not vanish.
RANGE = 25.0


@dataclass(frozen=True)
class LanguageOptions:
    #: Windows of texts that are learned from in each language, about so many and by hashed id and place: the bound on the
    #: driver's sample. The windows of a text are parts of all of it, so every word of every text may be drawn.
    windows_per_language: int = 400
    #: UTF-8 bytes of a window, about; some 400 words.
    window_bytes: int = 2400
    #: Lowest count of a word of the sample that gets a lexicon feature.
    lexicon_least: int = 3
    bits: int = 16
    sequence: int = 40
    #: Chance of a switch of text between two words of a training sequence.
    switch: float = 0.05
    #: Passes over the sample's words: the rounds of training follow from these and from the sample alone.
    epochs: int = 3
    rate: float = 0.2
    l2: float = 1e-5
    seed: int = 7


class Features:
    """Indices into the weight table: hashed n-grams of one to four bytes of the marked word, and its lexicon entry.

    The marks that stand before and after a word make its affixes n-grams of their own.
    """

    def __init__(self, bits: int, lexicon: list[str]) -> None:
        self.bits, self.size = bits, (1 << bits) + len(lexicon) + 1
        self.lexicon = {w: (1 << bits) + 1 + i for i, w in enumerate(lexicon)}

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature indices of all words, end to end, and each word's first position in them."""
        raw = [b"\x02" + w.lower().encode("utf-8", "replace") + b"\x03" for w in words]
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        word = np.repeat(np.arange(len(raw)), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        room = np.repeat(lengths, lengths) - place
        ids, owners, code = [], [], np.zeros(len(flat), dtype=np.uint64)
        for n in range(1, 5):
            last = flat[n - 1 :]
            code = (code[: len(last)] << np.uint64(8)) | last
            at = np.flatnonzero(room[: len(code)] >= n)
            ids.append((mix64(code[at] + (np.uint64(n) << np.uint64(40))) >> np.uint64(64 - self.bits)).astype(np.int64))
            owners.append(word[at])
        ids.append(np.array([self.lexicon.get(w.lower(), 1 << self.bits) for w in words], dtype=np.int64))
        owners.append(np.arange(len(words)))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(ids)[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class LanguageModel:
    labels: list[str]
    features: Features
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words for each label, relative to the best one, as positive factors."""
        if not words:
            return np.zeros((0, len(self.labels)), dtype=np.float32)
        out = np.zeros((len(words), len(self.labels)), dtype=np.float32)
        for at in range(0, len(words), 20_000):
            ids, starts = self.features.of(words[at : at + 20_000])
            scores = np.add.reduceat(self.weights[ids], starts, axis=0)
            out[at : at + 20_000] = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -RANGE))
        return out


def forward_backward(factors: np.ndarray, lengths: np.ndarray, transfer: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Marginal label distributions of all words of sequences that stand end to end in ``factors``.

    ``transfer[a, b]`` weighs label b after label a, and all first labels weigh the same; ``lengths`` are the sequences'
    words. Cost and memory are linear in the words.
    """
    n, k = factors.shape
    if not n:
        return factors.copy()
    own = -(-lengths // block)  # blocks of each sequence
    begin = np.concatenate([[0], np.cumsum(own)])
    blocks = int(begin[-1])
    seq = np.repeat(np.arange(len(lengths)), own)
    rank = np.arange(blocks) - begin[seq]
    size = np.minimum(lengths[seq] - rank * block, block)
    first = (np.cumsum(lengths) - lengths)[seq] + rank * block
    order = np.argsort(-size, kind="stable")  # at step t the blocks longer than t are a prefix
    size, first, place = size[order], first[order], np.argsort(order, kind="stable")
    live = np.searchsorted(-size, -np.arange(block), side="left")
    live = [int(x) for x in live]
    steps, opening = int(size.max()), (rank == 0)[order]
    transfer = transfer.astype(np.float32)

    product = np.tile(np.eye(k, dtype=np.float32), (blocks, 1, 1))  # of each block, entry label by exit label
    for t in range(steps):
        m = live[t]
        e = factors[first[:m] + t]
        p = (product[:m] @ transfer) * e[:, None, :]
        if t == 0:  # no transition leads to a sequence's first word
            p[opening] = np.eye(k, dtype=np.float32) * e[opening][:, None, :]
        product[:m] = p / p.max(axis=(1, 2), keepdims=True)
    entry, leave = np.full((blocks, k), 1.0 / k, dtype=np.float32), np.ones((blocks, k), dtype=np.float32)
    deepest = int(own.max())
    for r in range(1, deepest):  # chain the blocks of each sequence, forwards and backwards
        now = np.flatnonzero(own > r)
        a, b = place[begin[now] + r - 1], place[begin[now] + r]
        v = (entry[a][:, None, :] @ product[a])[:, 0, :]
        entry[b] = v / v.sum(axis=1, keepdims=True)
        c, d = place[begin[now] + own[now] - r], place[begin[now] + own[now] - r - 1]
        u = (product[c] @ leave[c][:, :, None])[:, :, 0]
        leave[d] = u / u.sum(axis=1, keepdims=True)
    alpha = np.empty_like(factors)
    state = entry
    for t in range(steps):
        m = live[t]
        at = first[:m] + t
        v = (state[:m] @ transfer) * factors[at]
        if t == 0:
            v[opening] = factors[at][opening]
        state[:m] = v / v.sum(axis=1, keepdims=True)
        alpha[at] = state[:m]
    state = leave
    for t in range(steps - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        both = alpha[at] * state[:m]
        alpha[at] = both / both.sum(axis=1, keepdims=True)
        v = (state[:m] * factors[at]) @ transfer.T
        state[:m] = v / v.sum(axis=1, keepdims=True)
    return alpha


def fit(samples: list[tuple[str, list[str]]], o: LanguageOptions) -> LanguageModel:
    """Fit weights and transitions by stochastic gradient ascent on the conditional likelihood of spliced sequences."""
    labels = sorted({lang for lang, _ in samples})
    counts = Counter(w.lower() for _, words in samples for w in words)
    features = Features(o.bits, sorted(w for w, c in counts.items() if c >= o.lexicon_least))
    k, rng = max(1, len(labels)), np.random.default_rng(o.seed)
    model = LanguageModel(labels, features, np.zeros((features.size, k), dtype=np.float32), np.zeros((k, k)))
    if k == 1:
        return model
    spot = {lang: i for i, lang in enumerate(labels)}
    names: dict[str, int] = {}
    pools = [[] for _ in labels]
    for lang, words in samples:
        if lang in spot and words:
            pools[spot[lang]].append(np.array([names.setdefault(w, len(names)) for w in words]))
    ids, starts = features.of(list(names))
    ends = np.append(starts[1:], len(ids))
    square, square_t = np.full(model.weights.shape, 1e-2), np.full((k, k), 1.0)
    total = sum(len(p) for pool in pools for p in pool)
    batch = 64
    rounds = max(1, o.epochs * total // (batch * o.sequence))
    for _ in range(rounds):
        words, gold = np.zeros((batch, o.sequence), dtype=np.int64), np.zeros((batch, o.sequence), dtype=np.int64)
        for b in range(batch):
            t = 0
            while t < o.sequence:  # segments of texts of random languages
                lang = int(rng.integers(k))
                text = pools[lang][int(rng.integers(len(pools[lang])))]
                run = min(int(rng.geometric(o.switch)), o.sequence - t, len(text))
                at = int(rng.integers(len(text) - run + 1))
                words[b, t : t + run], gold[b, t : t + run] = text[at : at + run], lang
                t += run
        flat, inverse = np.unique(words, return_inverse=True)
        inverse = inverse.reshape(batch, o.sequence)
        picks = np.concatenate([ids[starts[w] : ends[w]] for w in flat])
        edge = np.cumsum([0, *(ends[w] - starts[w] for w in flat)])
        scores = np.add.reduceat(model.weights[picks], edge[:-1], axis=0).astype(np.float64)
        e = scores[inverse]
        a = np.exp(model.transitions)
        f = np.exp(e - e.max(axis=2, keepdims=True))
        alpha, beta = np.zeros_like(f), np.ones_like(f)
        for t in range(o.sequence):
            v = f[:, t] * (alpha[:, t - 1] @ a if t else 1.0 / k)
            alpha[:, t] = v / v.sum(axis=1, keepdims=True)
        pair = np.zeros((k, k))
        for t in range(o.sequence - 2, -1, -1):
            w = f[:, t + 1] * beta[:, t + 1]
            joint = alpha[:, t, :, None] * a * w[:, None, :]
            pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            v = w @ a.T
            beta[:, t] = v / v.sum(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        truth = np.eye(k)[gold]
        per_word = np.zeros((len(flat), k))
        np.add.at(per_word, inverse.ravel(), (truth - post).reshape(-1, k))
        grad = np.zeros_like(model.weights, dtype=np.float64)
        np.add.at(grad, picks, np.repeat(per_word, np.diff(edge), axis=0))
        used = np.unique(picks)
        g = grad[used] - o.l2 * model.weights[used]
        square[used] += g**2
        model.weights[used] += (o.rate * g / np.sqrt(square[used])).astype(np.float32)
        gt = np.zeros((k, k))
        np.add.at(gt, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
        gt -= pair
        square_t += gt**2
        model.transitions += o.rate * gt / np.sqrt(square_t)
    return model


def fit_language(docs: DataFrame, learn: Column, options: LanguageOptions | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of the rows where ``learn`` holds and text and language are not null, of every language."""
    o = options or LanguageOptions()
    tune(docs.sparkSession)
    known = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    windows = F.ceil((F.octet_length(F.col(text_col)) + 1) / o.window_bytes).cast("int")
    known = known.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit(1)).alias("h"), F.col(text_col).alias("text"), windows.alias("windows"))
    sizes = known.groupBy("lang").agg(F.sum("windows").alias("n"))  # a row per language
    parts = known.join(F.broadcast(sizes), "lang").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    chosen = parts.where(hashed_share(F.xxhash64("h", "part"), o.windows_per_language, F.col("n"))).select("lang", "h", "text", "windows", "part")

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, h, texts, windows, parts = batch.columns
            cut = []
            for text, n, i in zip(texts.to_pylist(), windows.to_pylist(), parts.to_pylist(), strict=True):
                words = text.split()
                cut.append(words[i * len(words) // n : (i + 1) * len(words) // n])
            yield pa.RecordBatch.from_arrays([lang, h, parts, pa.array(cut, type=pa.list_(pa.string()))], ["lang", "h", "part", "words"])

    rows = chosen.mapInArrow(lean(window), "lang string, h long, part int, words array<string>").collect()  # a bounded sample
    return fit([(lang, words) for lang, _, _, words in sorted((r.lang, r.h, r.part, r.words) for r in rows)], o)


class Labeller:
    """Applies a model to batches of texts; scores of distinct words are kept in a table."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.transfer = np.exp(model.transitions)
        self.reset()

    def reset(self) -> None:
        self.table: dict[str, int] = {}
        self.factors = np.zeros((0, max(1, len(self.model.labels))), dtype=np.float32)
        self.lettered = np.zeros(0, dtype=bool)

    def ids(self, words: list[str]) -> np.ndarray:
        found = list(map(self.table.get, words))
        if None in found:
            new = [w for w in dict.fromkeys(words) if w not in self.table]
            for w in new:
                self.table[w] = len(self.table)
            self.factors = np.concatenate([self.factors, self.model.emissions(new)])
            self.lettered = np.concatenate([self.lettered, np.array([_LETTER.search(w) is not None for w in new])])
            found = list(map(self.table.get, words))
        return np.array(found, dtype=np.int64)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label distributions of the words of all texts, which words have letters, and each text's number of words."""
        if len(self.table) > TABLE:
            self.reset()
        cut = [(t or "").split() for t in texts]
        lengths = np.array([len(c) for c in cut], dtype=np.int64)
        ids = self.ids([w for c in cut for w in c])
        some = np.flatnonzero(lengths)
        return forward_backward(self.factors[ids], lengths[some], self.transfer), self.lettered[ids], lengths

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Predicted language and score of each text."""
        if not self.model.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        marginals, lettered, lengths = self.words(texts)
        owner = np.repeat(np.arange(len(texts)), lengths)[lettered]
        sums = np.stack([np.bincount(owner, marginals[lettered, j], len(texts)) for j in range(marginals.shape[1])], axis=1)
        n = np.bincount(owner, minlength=len(texts))
        best = sums.argmax(axis=1)
        score = np.where(n > 0, sums[np.arange(len(texts)), best] / np.maximum(n, 1), 0.0)
        return [self.model.labels[b] if m else UNKNOWN for b, m in zip(best, n, strict=True)], np.clip(score, 0.0, 1.0)


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """Label every whole text: the columns of ``docs`` and ``lang_pred`` and ``lang_score``, or what these are to be named.

    ``lang_pred`` is the language with the highest mean posterior over the words that have letters, ``lang_score`` that
    mean. Ties go to the first label in order.

    Defined cases: a text that is null, empty or has no letters is ``und`` with score 0, and so is every text if no
    language was learned; texts of any length are labelled whole; repeated rows get equal labels; an empty table gives
    an empty result. Columns of ``docs`` named as the two new ones are replaced.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")  # type: ignore[call-overload]
    @lean
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(shared.value)
        for batch in batches:
            langs, scores = labeller.texts(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], ["lang", "score"])

    names = [c for c in docs.columns if c not in (pred_col, score_col)]
    found = docs.select(F.struct(*names).alias("row"), label(text_of(text_col)).alias("found"))
    return found.select(*(F.col("row").getField(c).alias(c) for c in names), F.col("found.lang").alias(pred_col), F.col("found.score").alias(score_col))


def word_languages(texts: list[str | None], model: LanguageModel) -> list[list[tuple[str, str, float]]]:
    """For each text its words with their most likely languages and posteriors."""
    labeller = Labeller(model)
    marginals, _, lengths = labeller.words(texts)
    out, at = [], 0
    for text, n in zip(texts, lengths, strict=True):
        rows = marginals[at : at + n]
        out.append([(w, model.labels[int(r.argmax())], float(r.max())) for w, r in zip((text or "").split(), rows, strict=True)])
        at += n
    return out
