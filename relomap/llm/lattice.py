"""Language-model scoring by subword lattice likelihood.

The model draws pieces of an existing vocabulary independently, each as a last piece of its word or not; a text's
probability is the sum over all ways to cut its marked words into pieces, by forward recursion (in log space where plain
numbers are too small). The
vocabulary file fixes the pieces and their first weights (its scores are ranks, not probabilities, so weights fall with
the rank); expectation-maximisation over the training texts' word counts then sets the probabilities. Pieces never cross
words, so each distinct word's marginal is computed once and a text's is the sum over its words and the end.

A corpus mixes languages and kinds of text, so the model is a mixture of such piece models, one for each of a few latent
classes, and a text's probability is marginal over classes too. Seeds of the classes come from a bounded sample; the
classes are then estimated again over all training texts, each of them is put into its likeliest class, and the classes'
piece models are learned from all of their texts.

A word-count baseline with add-one smoothing is returned beside it. Its counts are joined: the commonest words (a
bounded number) from a broadcast table, all others by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relomap.llm.common import flat_bytes, hashed_share, lean, mix64, row_ids, text_of, tune, written

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
#: Texts have A to Z in lower case only, so a piece with one of them occurs in no word.
_CAPITAL = re.compile(rb"[A-Z]")
#: Bytes of marked words whose lattices are worked on together.
STRETCH = 1 << 16
#: Words of fewer bytes are summed as plain probabilities first. None of these sums exceeds 1, so what is lost to underflow
#: (below 1e-307) is nothing beside a word's probability over ``TINY``; words of less are summed in log space.
SHORT, TINY = 128, 1e-250
#: Arcs whose shares are counted together.
ARCS = 1 << 18
#: Distinct words that a worker's table holds besides the broadcast ones, and that a partial count holds.
TABLE = 150_000


@dataclass(frozen=True)
class LatticeOptions:
    vocabulary: str = ""
    #: Rounds of expectation-maximisation, each over all training words.
    rounds: int = 5
    classes: int = 10
    #: Training texts, about so many and by hashed content, that the classes' seeds are found on.
    seed_texts: int = 1200
    #: Passes over all training texts that estimate the classes again, from those seeds.
    class_rounds: int = 2
    #: Occurrences that the vocabulary's own scores are worth, over all pieces, beside the counts of the training words.
    prior: float = 400.0
    #: Commonest words whose counts are broadcast; a bound on that table, not on the words counted.
    common: int = 100_000


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces that lower-cased words can hold, as bytes with a space for the mark, and their first log weights.

    The weights are two for each piece: first all pieces inside words, then all as last ones. All single bytes are among
    the pieces, so every text has a positive probability.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weight = {bytes([b]): 1e-6 for b in range(256)}
    for i in range(sp.vocab_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        piece = sp.id_to_piece(i).replace(chr(0x2581), " ").encode()
        if not _CAPITAL.search(piece) and b" " not in piece[1:]:
            weight[piece] = weight.get(piece, 0.0) + 1.0 / (10.0 - sp.get_score(i))
    pieces = sorted(weight)
    return pieces, normalised(pieces, np.tile([weight[p] for p in pieces], 2))


def normalised(pieces: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Log-probabilities: those of the marked pieces sum to one, inside and last together, and so do the others'."""
    marked = np.tile([p.startswith(b" ") for p in pieces], 2)
    return np.log(weights / np.where(marked, weights[marked].sum(), weights[~marked].sum()))


class Lattice:
    """Marginals of words (bytes, without mark) under the piece log-probabilities of each class (rows of ``logp``).

    Words of like length are worked on together, up to ``STRETCH`` bytes of them, and a longer word in stretches of as
    many bytes, so that memory follows neither the number of words nor their length.
    """

    def __init__(self, pieces: list[bytes], logp: np.ndarray) -> None:
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        begin, code = np.cumsum(sizes) - sizes, np.zeros(len(pieces), dtype=np.uint64)
        codes, self.reach = np.zeros(len(pieces), dtype=np.uint64), int(sizes.max())
        #: By the upper bits of a code whether some piece may begin so: where none does, no longer one is looked for.
        self.begins = np.zeros(1 << 20, dtype=bool)
        for n in range(1, self.reach + 1):
            some = np.flatnonzero(sizes >= n)
            code[some] = code[some] * _STEP + flat[begin[some] + n - 1].astype(np.uint64) + np.uint64(1)
            mixed = code[some] * _MIX
            self.begins[(mixed >> np.uint64(44)).astype(np.int64)] = True
            ended = sizes[some] == n
            codes[some[ended]] = mixed[ended]
        order = np.argsort(codes)
        self.codes, self.entry = codes[order], order.astype(np.int32)
        #: Entry by class, so that an arc's weights in all classes lie together.
        self.weights = np.ascontiguousarray(np.atleast_2d(logp).T)
        self.chances = np.exp(self.weights)
        self.lengths = set(sizes.tolist())
        #: By the upper bits of a code the place of one such code, or -1; codes that share those bits are searched for.
        self.place = np.full(1 << 20, -1, dtype=np.int32)
        self.place[(self.codes >> np.uint64(44)).astype(np.int64)] = np.arange(len(codes))

    def _arcs(self, flat: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that start at the bytes of ``room``, which says how many bytes their words go on: start, length, entry."""
        at = np.arange(len(room), dtype=np.int32)
        code, found = np.zeros(len(room), dtype=np.uint64), []
        for n in range(1, self.reach + 1):
            keep = room[at] >= n
            at, code = at[keep], code[keep]
            if not len(at):
                break
            code = code * _STEP + flat[at + (n - 1)].astype(np.uint64) + np.uint64(1)
            mixed = code * _MIX
            upper = (mixed >> np.uint64(44)).astype(np.int64)
            keep = self.begins[upper]
            at, code, mixed, upper = at[keep], code[keep], mixed[keep], upper[keep]
            if n not in self.lengths:
                continue
            spot = self.place[upper]
            hit = np.flatnonzero(spot >= 0)
            spot, mixed = spot[hit], mixed[hit]
            other = np.flatnonzero(self.codes[spot] != mixed)
            spot[other] = np.minimum(np.searchsorted(self.codes, mixed[other]), len(self.codes) - 1)
            same = self.codes[spot] == mixed
            start = at[hit[same]]
            last = (room[start] == n) * np.int32(len(self.weights) // 2)
            found.append((start, np.full(len(start), n, dtype=np.int32), self.entry[spot[same]] + last))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))  # type: ignore[return-value]

    @staticmethod
    def _rounds(target: np.ndarray, n: np.ndarray, level: np.ndarray, nodes: int) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Level by level the arcs into its nodes, dealt into rounds, and the rounds' sizes.

        Arcs come by length ``n``, and a node has one arc of a length at most. The r-th arc of each node is in round r,
        with the nodes of most arcs first: a round then is a run of rows that stands beside the first nodes of the level.
        """
        rank, degree = np.empty(len(n), dtype=np.int64), np.zeros(nodes, dtype=np.int64)
        cuts = [0, *(np.flatnonzero(n[1:] != n[:-1]) + 1).tolist(), len(n)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rank[a:b] = degree[target[a:b]]
            degree[target[a:b]] += 1
        most = int(degree.max()) + 1
        round_ = level * most + rank
        order = np.argsort((round_ * most + (most - degree[target])) * nodes + target)
        round_ = round_[order]
        begin = np.concatenate([[0], np.flatnonzero(round_[1:] != round_[:-1]) + 1])
        sizes, opens = np.diff(np.append(begin, len(n))).tolist(), np.flatnonzero(round_[begin] % most == 0)
        ends = np.append(opens[1:], len(begin)).tolist()
        for first, last in zip(opens.tolist(), ends, strict=True):
            yield order[int(begin[first]) : int(begin[last]) if last < len(begin) else len(n)], sizes[first:last]

    @classmethod
    def _sweep(cls, values: np.ndarray, source: np.ndarray, target: np.ndarray, n: np.ndarray, level: np.ndarray, weight: Callable[[np.ndarray], np.ndarray], carried: bool = False) -> None:
        """Log of the sum over the arcs into each node; with ``carried``, added to what the nodes hold already."""
        for arcs, sizes in cls._rounds(target, n, level, len(values)):
            m = sizes[0]
            into = target[arcs[:m]]
            x = values[source[arcs]] + weight(arcs)
            if m == 1 and len(arcs) > 1:
                top = x.max(axis=0)
                x = (top + np.log(np.exp(x - top).sum(axis=0)))[None]
            elif len(arcs) > m:  # log of the sum over the arcs into a node, about their largest
                top, rows, at = x[:m].copy(), [], m
                for k in sizes[1:]:
                    rows.append(x[at : at + k])
                    np.maximum(top[:k], rows[-1], out=top[:k])
                    at += k
                total = np.exp(x[:m] - top)
                for row in rows:
                    row -= top[: len(row)]
                    total[: len(row)] += np.exp(row, out=row)
                x = np.log(total, out=total) + top
            values[into] = np.logaddexp(values[into], x) if carried else x

    def _chances(self, words: list[bytes]) -> np.ndarray:
        """Probability of each of some short words in each class, 0 where it is too small for a number."""
        s, n, entry, low, first, _ = self._joined(words)
        to = s + n
        values = np.zeros((int(to.max()) + 1, self.weights.shape[1]))
        values[first] = 1.0
        for arcs, sizes in self._rounds(to, n, low + n, len(values)):
            x = values[s[arcs]]
            x *= self.chances[entry[arcs]]
            at = sizes[0]
            for k in sizes[1:]:
                x[:k] += x[at : at + k]
                at += k
            values[to[arcs[: sizes[0]]]] = x[: sizes[0]]
        return values[np.append(first[1:] - 1, len(values) - 1)]

    def _shares(self, words: list[bytes], kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some short words the arcs' places in ``expected``, what they add there, and which words are too improbable.

        Nodes are numbered by place and then by word, so that those of a place lie together.
        """
        _, n, entry, low, _, owner = self._joined(words)
        many = len(words)
        w = self.chances[entry, kinds[owner]]
        source = low * many + owner
        target, level = source + n * np.int64(many), low + n
        last = np.array([len(x) + 1 for x in words], dtype=np.int64)
        top, ended = int(last.max()), last * many + np.arange(many)
        alpha, beta = np.zeros((top + 1) * many), np.zeros((top + 1) * many)
        alpha[:many], beta[ended] = 1.0, 1.0
        for values, by, other, places in ((alpha, level, source, range(1, top + 1)), (beta, low, target, range(top - 1, -1, -1))):
            order = np.argsort(by.astype(np.int16), kind="stable")
            ends = np.cumsum(np.bincount(by, minlength=top + 1)).tolist()
            own, far, weight = owner[order], other[order], w[order]
            for p in places:
                arcs = slice(ends[p - 1] if p else 0, ends[p])
                values[p * many : (p + 1) * many] += np.bincount(own[arcs], values[far[arcs]] * weight[arcs], many)
        total = alpha[ended]
        fine = total > TINY
        factor = np.where(fine, counts, 0.0) / np.where(fine, total, 1.0)
        return kinds[owner].astype(np.int64) * len(self.weights) + entry, alpha[source] * w * beta[target] * factor[owner], ~fine

    @staticmethod
    def _groups(words: list[bytes]) -> Iterator[np.ndarray]:
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        ends, first = np.cumsum(sizes[order]), 0
        while first < len(order):
            before = int(ends[first - 1]) if first else 0
            last = int(np.searchsorted(ends, before + STRETCH, side="right"))
            last = max(first + 1, min(last, int(np.searchsorted(sizes[order], 2 * sizes[order[first]], side="right"))))
            yield order[first:last]
            first = last

    def _joined(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Arcs of several words: start node, length, entry, place of start, the words' first nodes, and the arcs' words."""
        flat = np.frombuffer(b"".join(b" " + w for w in words), dtype=np.uint8)
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int32)
        begin = (np.cumsum(lengths) - lengths).astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        place = np.arange(len(flat), dtype=np.int32) - begin[word]
        start, n, entry = self._arcs(flat, lengths[word] - place)
        owner = word[start]
        return start + owner, n, entry, place[start].astype(np.int64), begin + np.arange(len(words), dtype=np.int32), owner  # a word has a node more than bytes

    def _stretches(self, word: bytes, back: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Arcs of one long word by stretches of starts: first and last start, start node in the stretch, length, entry."""
        flat = np.frombuffer(b" " + word, dtype=np.uint8)
        for a in sorted(range(0, len(flat), STRETCH), reverse=back):
            stop = min(a + STRETCH, len(flat))
            yield a, stop, *self._arcs(flat[a : stop + self.reach], len(flat) - np.arange(a, stop))

    def _forward(self, word: bytes, weights: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """The last node's value of one long word; ``keep`` takes those of all nodes."""
        ahead = np.full((self.reach + 1, weights.shape[1]), -np.inf)
        ahead[0] = 0.0
        for a, stop, start, n, entry in self._stretches(word):
            values = np.full((stop - a + self.reach + 1, weights.shape[1]), -np.inf)
            values[: self.reach + 1] = ahead
            self._sweep(values, start, start + n, n, (start + n).astype(np.int64), lambda i, entry=entry: weights[entry[i]], True)
            ahead = values[stop - a :]
            if keep is not None:
                keep[a : stop + 1] = values[: stop - a + 1, 0]
        return ahead[0]

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural-log probability of each marked word in each class, over all its segmentations."""
        out = np.zeros((len(words), self.weights.shape[1]))
        for group in self._groups(words):
            some = [words[i] for i in group.tolist()]
            if len(some[-1]) < SHORT:
                chance = self._chances(some)
                fine = chance.min(axis=1) > TINY
                out[group[fine]] = np.log(chance[fine])
                group = group[~fine]
                if not len(group):
                    continue
                some = [words[i] for i in group.tolist()]
            if len(some[0]) >= STRETCH:
                out[group[0]] = self._forward(some[0], self.weights)
                continue
            s, n, entry, low, first, _ = self._joined(some)
            alpha = np.full((int((s + n).max()) + 1, out.shape[1]), -np.inf)
            alpha[first] = 0.0
            self._sweep(alpha, s, s + n, n, low + n, lambda i, entry=entry: self.weights[entry[i]])
            out[group] = alpha[np.append(first[1:] - 1, len(alpha) - 1)]
        return out

    def expected(self, words: list[bytes], kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts by class, of words that occur ``counts`` times in classes ``kinds``."""
        size, held, waiting = len(self.weights), [], 0
        out = np.zeros(self.weights.size)
        for group in self._groups(words):
            some = [words[i] for i in group.tolist()]
            if len(some[-1]) < SHORT:
                places, shares, left = self._shares(some, kinds[group], counts[group])
                held.append((places, shares))
                waiting += len(places)
                if waiting > ARCS:
                    out += np.bincount(*map(np.concatenate, zip(*held, strict=True)), len(out))
                    held, waiting = [], 0
                group = group[left]
                if not len(group):
                    continue
                some = [words[i] for i in group.tolist()]
            if len(some[0]) >= STRETCH:
                kind = int(kinds[group[0]])
                out[kind * size : (kind + 1) * size] += self._expected_long(some[0], kind) * counts[group[0]]
                continue
            s, n, entry, low, first, owner = self._joined(some)
            e = s + n
            kind = kinds[group][owner]
            w = self.weights[entry, kind]
            alpha, beta = (np.full(int(e.max()) + 1, -np.inf) for _ in range(2))
            last = np.append(first[1:] - 1, len(alpha) - 1)
            alpha[first], beta[last] = 0.0, 0.0
            self._sweep(alpha, s, e, n, low + n, w.__getitem__)
            self._sweep(beta, e, s, n, low.max() - low, w.__getitem__)
            share = np.exp(alpha[s] + w + beta[e] - alpha[last[owner]]) * counts[group][owner]
            out += np.bincount(kind * size + entry, share, len(out))
        if held:
            out += np.bincount(*map(np.concatenate, zip(*held, strict=True)), len(out))
        return out.reshape(-1, size)

    def _expected_long(self, word: bytes, kind: int) -> np.ndarray:
        own = self.weights[:, kind : kind + 1]
        alpha = np.empty(len(word) + 2)
        total = float(self._forward(word, own, alpha)[0])
        behind = np.full(self.reach + 1, -np.inf)  # of the nodes from the stretch's end on
        behind[0] = 0.0
        out = np.zeros(len(self.weights))
        for a, stop, start, n, entry in self._stretches(word, back=True):
            beta = np.full(stop - a + self.reach + 1, -np.inf)
            beta[stop - a :] = behind
            w = own[entry, 0]
            self._sweep(beta, start + n, start, n, ((stop - a) - start).astype(np.int64), w.__getitem__)
            out += np.bincount(entry, np.exp(alpha[a + start] + w + beta[start + n] - total), len(out))
            behind = beta[: self.reach + 1].copy()
        return out


def words_of(text: str) -> list[bytes]:
    """Words of a text with A to Z in lower case: runs of bytes other than ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


#: Hash buckets of words by which classes are told apart, and texts whose bucket counts are held at once.
BUCKETS, GRID, SLICE = 4096, 256, 1 << 20


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


class _Hasher:
    """Buckets of the words of texts given as bytes end to end, without making the words."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def __call__(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's bucket and text."""
        n = len(flat)
        if len(self.power) < n + 1:
            self.power = np.cumprod(np.full(n + 1, _STEP, dtype=np.uint64))
            self.inverse = np.cumprod(np.full(n + 1, pow(int(_STEP), -1, 1 << 64), dtype=np.uint64))
        inside, first = ~_GAP[flat], np.zeros(n + 1, dtype=bool)
        first[offsets[:-1]] = True  # a text's first byte follows nothing
        begin = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | first[:-1]))
        end = np.flatnonzero(inside & (~np.append(inside[1:], False) | np.append(first[1:-1], True))) + 1 if n else begin
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((_LOWER[flat].astype(np.uint64) + np.uint64(1)) * self.power[:n])])
        bucket = mix64((sums[end] - sums[begin]) * self.inverse[begin]) % np.uint64(BUCKETS)
        return bucket.astype(np.int64), np.searchsorted(offsets, begin, side="right") - 1


def _buckets(words: list[bytes]) -> np.ndarray:
    return _Hasher()(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum([0, *map(len, words)]))[0]


def _bucket_grids(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """By groups of texts the first one's place, and how many of each text's words are in each bucket."""
    flat, offsets = flat_bytes(column)
    hasher, i = _Hasher(), 0
    while i < len(column):  # at most GRID texts and about SLICE bytes, unless one text is longer
        j = min(i + GRID, max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1))
        at, owner = hasher(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, np.bincount(owner * BUCKETS + at, minlength=(j - i) * BUCKETS).reshape(-1, BUCKETS).astype(np.float64)
        i = j


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, grid in _bucket_grids(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(list(grid.astype(np.float32)), type=pa.list_(pa.float32()))], ["row"])


def seed_classes(rows: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Log weights (class, bucket of words) of a mixture of multinomials over rows of bucket counts.

    The rows are seen in the space of their leading directions, where rows that are as independent as can be, taken
    greedily, are the first centres; expectation-maximisation follows. A short text says little, so its row is as short
    as its words are few.
    """
    rows = rows[rows.sum(axis=1) > 0]
    if not len(rows):
        return np.zeros((1, BUCKETS))
    sizes = rows.sum(axis=1, keepdims=True)
    unit = np.sqrt(rows / sizes) * np.sqrt(sizes / (sizes + 50.0))
    spread, vectors = np.linalg.eigh(unit @ unit.T)
    k = min(classes, len(rows))
    space = vectors[:, -k:] * np.sqrt(np.maximum(spread[-k:], 0))
    left, centres = space.copy(), []
    for _ in range(k):
        centres.append(int((left**2).sum(axis=1).argmax()))
        axis = left[centres[-1]] / max(np.linalg.norm(left[centres[-1]]), 1e-12)
        left = left - np.outer(left @ axis, axis)
    near = space / np.maximum(np.linalg.norm(space, axis=1, keepdims=True), 1e-12)
    share = np.zeros((len(rows), k))
    share[np.arange(len(rows)), (near @ near[centres].T).argmax(axis=1)] = 1.0
    for _ in range(rounds):
        sums = share.T @ rows + 0.05
        logw = np.log(sums / sums.sum(axis=1, keepdims=True))
        score = rows @ logw.T + np.log(share.sum(axis=0) + 1.0)
        share = np.exp(score - score.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
    return logw


def reseeded(texts: DataFrame, weights: np.ndarray) -> np.ndarray:
    """The classes' log weights after one more step of expectation-maximisation, over all of the column ``text``.

    ``weights`` has, beside a class's column for each bucket, a last one with the log of its share of the texts. A task
    holds one sum for each class and bucket, whatever the texts.
    """
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logw = shared.value
        sums = np.zeros(logw.shape)
        for batch in batches:
            for _, grid in _bucket_grids(batch.column(0)):
                grid = grid[grid.any(axis=1)]
                score = grid @ logw[:, :-1].T + logw[:, -1]
                share = np.exp(score - score.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                sums[:, :-1] += share.T @ grid
                sums[:, -1] += share.sum(axis=0)
        flat = sums.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int64()), pa.array(flat[some])], ["entry", "n"])

    found = texts.select("text").mapInArrow(lean(expect), "entry long, n double").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(weights.size)
    sums[found.column("entry").to_numpy()] = found.column("n").to_numpy()
    sums = sums.reshape(weights.shape)
    words, share = sums[:, :-1] + 0.05, sums[:, -1:] + 1.0
    return np.hstack([np.log(words / words.sum(axis=1, keepdims=True)), np.log(share / share.sum())])


def word_counts(texts: DataFrame, seeds: np.ndarray) -> DataFrame:
    """``word``, ``kind``, ``c`` over the column ``text``; counted in part by each task, then summed.

    A text's class is the one whose ``seeds`` give it the most weight (last column: whatever its words). The row with a null word counts texts.
    """
    shared = texts.sparkSession.sparkContext.broadcast(seeds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter[bytes]] = [Counter() for _ in shared.value]
        ended: Counter[int] = Counter()

        def out(kind: int) -> pa.RecordBatch:
            words, n = list(held[kind]), list(held[kind].values())
            if ended[kind]:
                words.append(None)
                n.append(ended.pop(kind))
            held[kind].clear()
            return pa.RecordBatch.from_arrays([pa.array(words, type=pa.binary()), pa.array([kind] * len(n), type=pa.int32()), pa.array(n, type=pa.int64())], ["word", "kind", "c"])

        for batch in batches:
            for first, grid in _bucket_grids(batch.column(0)):
                kinds = (grid @ shared.value[:, :-1].T + shared.value[:, -1]).argmax(axis=1).tolist()
                for text, kind in zip(batch.column(0).slice(first, len(grid)).to_pylist(), kinds, strict=True):
                    held[kind].update(words_of(text))
                    ended[kind] += 1
                    if sum(map(len, held)) > TABLE:
                        yield from map(out, range(len(held)))
        yield from map(out, range(len(held)))

    return texts.select("text").mapInArrow(lean(count), "word binary, kind int, c long").groupBy("word", "kind").agg(F.sum("c").alias("c"))


def estimate(counts: DataFrame, classes: int, o: LatticeOptions) -> tuple[list[bytes], np.ndarray]:
    """Pieces and their log-probabilities in each class, by expectation-maximisation over the counts of all words.

    The vocabulary's own scores weigh the segmentations of the first round, and in every round they are worth ``prior``
    occurrences, dealt over the pieces by weight: they decide where the training words say little.
    """
    spark = counts.sparkSession
    pieces, start = vocabulary(o.vocabulary)
    logp = np.tile(start, (classes, 1))
    before = np.exp(start) * o.prior / np.exp(start).sum()
    words = counts.where("word IS NOT NULL").select("word", "kind", "c")
    for _ in range(o.rounds):
        shared = spark.sparkContext.broadcast(logp)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, sums = Lattice(pieces, shared.value), np.zeros(shared.value.shape)
            for batch in batches:
                if batch.num_rows:
                    sums += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float64))
            flat = sums.ravel()
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int64()), pa.array(flat[some])], ["entry", "n"])

        found = words.mapInArrow(lean(expect), "entry long, n double")
        found = found.groupBy("entry").agg(F.sum("n").alias("n")).toArrow()  # two rows per piece and class at most
        sums = np.zeros(logp.size)
        sums[found.column("entry").to_numpy()] = found.column("n").to_numpy()
        logp = np.stack([normalised(pieces, row + before) for row in sums.reshape(logp.shape)])
    return pieces, logp


class _Index(dict):
    """Numbers for words; a word that is new gets the next one and is noted in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def _common(counts: DataFrame, shared, most: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """At most ``most`` of the commonest words, with counts and marginals: all words from some count on."""
    steps = counts.groupBy(F.floor(F.log2("c") * 16).alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect()  # under 1100 steps
    least, held = None, 0
    for step, n in steps:
        held += n
        if held > most:
            break
        least = step

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            rows = lattice.marginals(batch.column(0).to_pylist()) if batch.num_rows else []
            yield batch.append_column("m", pa.array(list(rows), type=pa.list_(pa.float64())))

    if least is None:
        return [], np.zeros(0), np.zeros((0, len(shared.value[1])))
    top = counts.where(F.floor(F.log2("c") * 16) >= least).select("word", "c").mapInArrow(lean(measure), "word binary, c long, m array<double>").toArrow()
    rows = np.asarray(top.column("m").combine_chunks().flatten()).reshape(top.num_rows, -1)
    return top.column("word").to_pylist(), top.column("c").to_numpy(), rows


def _scorer(pieces, common, end_log, log_prior, log_word, log_end):
    """Rows of texts to rows with what is known locally, and the words that must be looked up."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = pieces.value
        lattice, ids = Lattice(names, logp), row_ids()
        known_words, known_counts, known_marginals = common.value
        index, others, first = _Index(), [], len(known_words)
        room = first + TABLE  # grown where one batch needs more
        marginal, counts, logs_of = np.empty((room, len(logp))), np.full(room, -1), np.zeros(room)
        marginal[:first], counts[:first], logs_of[:first] = known_marginals, known_counts, np.log10(known_counts + 1.0)

        def reset() -> None:
            index.clear(), others.clear()
            index.update(zip(known_words, range(first), strict=True))

        reset()
        for batch in batches:
            if len(index) > first + TABLE:
                reset()
            cut = [words_of(t) for t in batch.column(1).to_pylist()]
            lengths = np.array([len(c) for c in cut], dtype=np.int64)
            at = np.fromiter(map(index.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(lengths.sum()))
            if index.fresh:
                if len(index) > len(counts):
                    more = len(index) + TABLE // 4 - len(counts)
                    marginal = np.concatenate([marginal, np.empty((more, len(logp)))])
                    counts, logs_of = np.append(counts, np.full(more, -1)), np.append(logs_of, np.zeros(more))
                marginal[len(index) - len(index.fresh) : len(index)] = lattice.marginals(index.fresh)
                others += index.fresh
                index.fresh.clear()
            owner = np.repeat(np.arange(len(cut)), lengths)
            c, n = counts[at], len(cut)
            model = np.zeros((n, len(logp)))
            some = np.flatnonzero(lengths)
            if len(some):
                model[some] = np.add.reduceat(marginal[at], (np.cumsum(lengths) - lengths)[some], axis=0)
            model += log_prior + lengths[:, None] * log_word + log_end
            model = np.logaddexp.reduce(model, axis=1)
            logs = np.bincount(owner, logs_of[at], n) + end_log
            known = np.bincount(owner, c > 0, n).astype(np.int64)
            away = np.flatnonzero(c < 0)  # each text's other words once, with how often they occur in it
            once, many = np.unique(owner[away] * len(counts) + at[away], return_counts=True)
            rare = [others[i] for i in (once % len(counts) - first).tolist()]
            ends = pa.array(np.searchsorted(once, np.arange(n + 1) * len(counts)), type=pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, type=t)) for v, t in ((rare, pa.binary()), (many, pa.int64()))]
            rows = pa.array([next(ids) for _ in range(n)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(lengths + 1), pa.array(known), pa.array(logs), pa.array(model / np.log(10.0)), *lists], ["row_id", "doc_id", "n_tokens", "known", "logs", "score", "rare", "many"])

    return score


@dataclass
class LatticeModel:
    """A mixture of piece models with what a text's probability needs beside them, and the training words' counts."""

    pieces: list[bytes]
    #: Log-probabilities by class (rows): all pieces inside words, then all as last ones.
    logp: np.ndarray
    #: Log share of each class, and the logs of the chances that a text of it goes on with a word, and that it ends.
    prior: np.ndarray
    more: np.ndarray
    end: np.ndarray
    #: ``word``, ``c``: counts over the training texts.
    counts: DataFrame
    texts: int
    words: int
    distinct: int


def fit_lattice(texts: DataFrame, options: LatticeOptions) -> LatticeModel:
    """Learn from all rows of the column ``text``, which has no nulls."""
    spark, o = texts.sparkSession, options
    tune(spark)
    chosen = texts.where(hashed_share(F.col("text"), o.seed_texts, texts.count())).select("text").distinct()
    sample = chosen.mapInArrow(lean(_bucket_rows), "row array<float>").toArrow().column("row").combine_chunks()
    seeds = seed_classes(np.asarray(sample.flatten(), dtype=np.float64).reshape(-1, BUCKETS), o.classes)
    seeds = np.hstack([seeds, np.zeros((len(seeds), 1))])
    for _ in range(o.class_rounds):
        seeds = reseeded(texts, seeds)
    by_kind = written(spark, word_counts(texts, seeds), "word-counts")
    counts = by_kind.where("word IS NOT NULL").groupBy("word").agg(F.sum("c").alias("c"))
    words, ends = np.zeros(len(seeds)), np.zeros(len(seeds))
    for k, w, t in by_kind.groupBy("kind").agg(F.sum(F.when(F.col("word").isNotNull(), F.col("c"))), F.sum(F.when(F.col("word").isNull(), F.col("c")))).collect():  # a row per class
        words[k], ends[k] = w or 0, t or 0
    end = (ends + 1) / (words + ends + 2)
    return LatticeModel(
        *estimate(by_kind, len(seeds), o), np.log((ends + 1) / (ends + 1).sum()), np.log1p(-end), np.log(end), counts, int(ends.sum()), int(words.sum()), counts.count()
    )


def score_documents(docs: DataFrame, learn: Column, options: LatticeOptions, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probability of every whole text, by a model learned from the rows where ``learn`` holds.

    Columns: ``doc_id``, ``learned_from``, ``n_tokens`` (words and one end), ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (add-one word counts), ``score`` (subword lattice). A-Z count as a-z.

    Defined cases: a null text counts as empty and has the end as its only token; with no training rows every count is
    0 and the vocabulary's own scores alone weigh the pieces; texts of any length are scored whole, and words too; rows
    with null or repeated ids are rows as any other; an empty table gives an empty result; other columns are ignored.
    """
    tune(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return score_texts(base, fit_lattice(base.where("learn").select("text"), options), options)


def score_texts(base: DataFrame, model: LatticeModel, options: LatticeOptions) -> DataFrame:
    """``score_documents`` for ``doc_id``, ``text``, ``learn`` without nulls in the last two, by a model that is there."""
    spark, kind = base.sparkSession, base.schema["doc_id"].dataType.simpleString()
    tokens, distinct = model.words + model.texts, model.distinct + (model.texts > 0)
    shared = spark.sparkContext.broadcast((model.pieces, model.logp))
    common = spark.sparkContext.broadcast(_common(model.counts, shared, options.common))
    schema = f"row_id long, doc_id {kind}, n_tokens long, known long, logs double, score double, rare array<binary>, many array<long>, learn boolean"
    scorer = _scorer(shared, common, float(np.log10(model.texts + 1)), model.prior, model.more, model.end)

    def with_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: list[pa.Array] = []

        def pass_on() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sides.append(batch.column(2))
                yield batch

        for out in scorer(pass_on()):
            yield out.append_column("learn", sides.pop(0))

    rows = written(spark, base.mapInArrow(lean(with_side), schema), "scored")
    looked = rows.select("row_id", F.explode(F.arrays_zip("rare", "many")).alias("w")).select("row_id", F.col("w.rare").alias("word"), F.col("w.many").alias("many"))
    # Words outside the broadcast table: counts of the common ones are known, so they need not take part.
    joined = looked.join(model.counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = joined.groupBy("row_id").agg(F.sum(F.col("many") * F.log10(F.col("c") + 1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("many")).otherwise(0)).alias("seen"))
    space = float(np.log10(tokens + distinct + 1))
    return rows.drop("rare", "many").join(rest, "row_id", "left").select(
        "doc_id",
        F.col("learn").alias("learned_from"),
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0)) + F.lit(int(model.texts > 0))).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        "score",
    )
