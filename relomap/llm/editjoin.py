"""Edit-distance pieces of line dedup: segment signatures and banded bit-parallel verification.

A line within ``edits`` of another shares one of its ``edits + 1`` segments with it, at nearly the same place. Each line
therefore indexes its segments under (length, segment number, content), and probes, for each length at most ``edits``
below its own, the substrings that a multi-match-aware window allows.
"""

from __future__ import annotations

import numpy as np

from relomap.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15
#: Space, tab, vertical tab, form feed and carriage return part words; from this code point on (CJK and dense scripts
#: after it) each code point is a word.
_INSIDE, _DENSE = ~np.isin(np.arange(33), [32, 9, 11, 12, 13]), 0x2E80
#: Code points of lines that are signed together, unless one line is longer.
SLICE = 1 << 20
#: Signatures that are made in one step.
CELLS = 400_000
#: Units from which on a pair's equal beginnings and ends are cut off before it is compared.
LONG = 64
#: Words of a band of lengths in the keys of word signatures.
BAND = 32


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment from 0, shift from the segment's place) of every substring that is probed.

    A line's own segments are not: lines of one length that share a segment in place meet as index rows.
    """
    out = []
    for delta in range(edits + 1):
        for i in range(edits + 1):
            room = edits - i
            out += [(delta, i, d) for d in range(max(-i, delta - room), min(i, delta + room) + 1) if delta or d]
    return out


def segments(length: np.ndarray, i: int | np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of segment ``i`` of lines of these lengths; the later segments take the remainder."""
    base, rest = length // (edits + 1), length % (edits + 1)
    short = edits + 1 - rest
    return base * i + np.maximum(i - short, 0), base + (i >= short)


class Signer:
    """Signatures of lines given as code points end to end.

    With a ``band`` a key knows its line's length only as a multiple of that many. The probes for the lengths of a band
    then share most of their substrings, so a line has about the square of its edits in keys instead of the cube.
    """

    def __init__(self, edits: int, band: int = 1) -> None:
        self.edits, self.probes, self.band = edits, probes(edits), band
        self._power = self._inverse = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._power) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            self._power = np.cumprod(np.full(n, _BASE, dtype=np.uint64)) * np.uint64(inverse)
            self._inverse = np.cumprod(np.full(n, inverse, dtype=np.uint64)) * np.uint64(_BASE)

    def sign(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays of (line number, is index, key): all of ``edits + 1`` segments and all probes of each line."""
        lines, roles, keys = [], [], []
        made = [(0, i, 0) for i in range(self.edits + 1)] + self.probes  # the index rows are ahead
        delta, segment, shift = (np.array(c, dtype=np.int64) for c in zip(*made, strict=True))
        first = 0
        while first < len(offsets) - 1:
            last = int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1
            last = min(max(last, first + 1), len(offsets) - 1)
            flat = points[offsets[first] : offsets[last]].astype(np.uint64) + np.uint64(1)
            self._powers(len(flat) + 1)
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(flat * self._power[: len(flat)])])
            start, length = offsets[first:last] - offsets[first], np.diff(offsets[first : last + 1])
            step = max(1, CELLS // len(delta))
            for at in range(0, last - first, step):  # lines by signatures
                own = slice(at, min(at + step, last - first))
                total = length[own, None] - delta
                place, size = segments(total, segment, self.edits)
                place = place + shift
                ok = (place >= 0) & (place + size <= length[own, None]) & (total >= self.edits + 1)
                total, size = total[ok], size[ok]
                a = (start[own, None] + place)[ok]
                h = (sums[a + size] - sums[a]) * self._inverse[a]
                if self.band > 1:  # the length no longer gives the segment's own
                    h = mix64(h + size.astype(np.uint64))
                column = np.broadcast_to(np.arange(len(delta)), ok.shape)[ok]
                key = mix64(mix64(h + (total // self.band).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) + (segment[column] + 1).astype(np.uint64))
                number = np.broadcast_to(np.arange(first + own.start, first + own.stop)[:, None], ok.shape)[ok]
                index = column <= self.edits
                if self.band > 1:  # each key of a line once, as an index key where it is one: a line's index keys are ahead
                    once = np.unique(mix64(number.astype(np.uint64) * np.uint64(_BASE)) ^ key, return_index=True)[1]
                    number, index, key = number[once], index[once], key[once]
                lines.append(number)
                roles.append(index)
                keys.append(key.view(np.int64))
            first = last
        if not lines:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
        return np.concatenate(lines), np.concatenate(roles), np.concatenate(keys)


def word_hashes(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of lines given as code points end to end: a hash for each word, and the lines' offsets into them."""
    hashes, ends, first, total = [], [np.zeros(1, dtype=np.int64)], 0, 0
    power = inverse = np.ones(1, dtype=np.uint64)
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        flat, own = points[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if len(power) < len(flat) + 1:
            power = np.cumprod(np.full(len(flat) + 1, _BASE, dtype=np.uint64))
            inverse = np.cumprod(np.full(len(flat) + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
        inside, cut = (flat > 32) | _INSIDE[np.minimum(flat, 32)], np.zeros(len(flat) + 1, dtype=bool)
        cut[own] = True
        dense = np.flatnonzero(flat >= _DENSE)
        cut[dense] = cut[dense + 1] = True
        gap = np.concatenate([[True], ~inside, [True]])
        starts = np.flatnonzero(inside & (gap[:-2] | cut[:-1]))
        stops = np.flatnonzero(inside & (gap[2:] | cut[1:])) + 1
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[: len(flat)])])
        hashes.append(mix64((sums[stops] - sums[starts]) * inverse[starts]))
        ends.append(np.searchsorted(starts, own[1:]) + total)
        total += len(starts)
        first = last
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), np.concatenate(ends)


class WordSigner:
    """Signatures of lines by word edits, of which a line of ``n`` words may have ``min(n // per, most)``.

    Each number of edits has a partition of its own. A pair's number is that of its shorter line, so a line that is only
    just long enough for its number probes among the lines of one edit less as well.
    """

    def __init__(self, per: int, most: int) -> None:
        self.per, self.most = per, most
        self.signers = {e: Signer(e, BAND) for e in range(1, most + 1)}

    def sign(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays of (line number, is index, key), as ``Signer.sign``."""
        words, at = word_hashes(points, offsets)
        size = np.diff(at)
        own = np.minimum(size // self.per, self.most)
        found = []
        for e, signer in self.signers.items():
            for probing in (False, True):
                pick = np.flatnonzero((own == e + 1) & (size - e < self.per * (e + 1)) if probing else own == e)
                if not len(pick):
                    continue
                ends = np.cumsum(size[pick])
                spots = np.repeat(at[pick] - (ends - size[pick]), size[pick]) + np.arange(ends[-1])
                number, index, key = signer.sign(words[spots], np.concatenate([[0], ends]))
                key = mix64(key.view(np.uint64) + np.uint64(e)).view(np.int64)
                found.append((pick[number], index & (not probing), key))  # in a band its own segments may be probes as well
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def within_words(points: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray, per: int, most: int) -> np.ndarray:
    """Whether lines ``left[k]`` and ``right[k]`` are within the word edits of the one with fewer words."""
    return within_growing(*word_hashes(points, offsets), left, right, per, most)


def within_growing(words: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, per: int, most: int) -> np.ndarray:
    """``within_words`` for lines given as the hashes of their words."""
    size = np.diff(at)
    edits = np.minimum(np.minimum(size[left], size[right]) // per, most)
    out = np.zeros(len(left), dtype=bool)
    for e in np.unique(edits[edits > 0]).tolist():
        some = np.flatnonzero(edits == e)
        out[some] = within(words, at, left[some], right[some], e)
    return out


def within(points: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray, edits: int) -> np.ndarray:
    """Whether lines ``left[k]`` and ``right[k]`` are within ``edits`` of each other, for all pairs k at once.

    The dynamic programme's band of ``2 * edits + 1`` diagonals is held as bit vectors, one word for each pair: the
    vertical differences are up to date after each character of the shorter line, and the score is followed along the
    band's lower edge and then along the last row.
    """
    width = 2 * edits + 1
    lengths = np.diff(offsets)
    swap = lengths[left] < lengths[right]
    a, b = np.where(swap, right, left), np.where(swap, left, right)  # a is the longer one
    m, n = lengths[a], lengths[b]
    out = np.zeros(len(a), dtype=bool)
    close = np.flatnonzero(m - n <= edits)
    a, b, m, n = a[close], b[close], m[close], n[close]
    start_a, start_b = offsets[a], offsets[b]
    for k in np.flatnonzero(n >= LONG).tolist():  # equal beginnings and ends cost nothing
        x, y = points[start_a[k] : start_a[k] + m[k]], points[start_b[k] : start_b[k] + n[k]]
        differ = x[: n[k]] != y
        head = int(differ.argmax()) if differ.any() else int(n[k])
        differ = x[m[k] - n[k] + head :] != y[head:]
        tail = int(differ[::-1].argmax()) if differ.any() else int(n[k]) - head
        start_a[k], start_b[k], m[k], n[k] = start_a[k] + head, start_b[k] + head, m[k] - head - tail, n[k] - head - tail
    out[close[n == 0]] = True  # what is left of the longer one is no longer than the edits
    rest = np.flatnonzero(n > 0)
    rest = rest[np.argsort(-n[rest], kind="stable")]
    start_a, start_b, m, n, order = start_a[rest], start_b[rest], m[rest], n[rest], close[rest]
    if not len(order):
        return out
    # Bit w stands for row j + w - edits of column j; rows above the first have vertical difference -1 going down to it.
    one = np.uint64(1)
    full = np.uint64((1 << width) - 1)
    vp = np.full(len(order), ((1 << width) - 1) & ~((1 << edits) - 1), dtype=np.uint64) & full
    vn = np.zeros(len(order), dtype=np.uint64)
    score = np.full(len(order), edits, dtype=np.int64)  # at row j + edits of column j
    across_band, bits = np.arange(width) - edits, one << np.arange(width, dtype=np.uint64)
    at = order
    last = len(points) - 1
    for j in range(int(n.max())):
        k = int(np.searchsorted(-n, -j, side="left"))  # pairs whose shorter line goes on; the others have their score
        if not k:
            break
        if j % 16 == 15:
            # Least value of the column, from the lower edge upwards; it never falls again, so such pairs are far apart.
            lower = np.minimum(2 * edits, m[:k] - j + edits)
            value, least = score[:k].copy(), score[:k].copy()
            for w in range(2 * edits, -1, -1):
                bit = np.uint64(w)
                down = ((vp[:k] >> bit) & one).astype(np.int64) - ((vn[:k] >> bit) & one).astype(np.int64)
                value = np.where(w <= lower - 1, value - down, value)
                least = np.minimum(least, value)
            keep = np.concatenate([least <= edits, np.ones(len(n) - k, dtype=bool)])
            if not keep.all():
                start_a, start_b, m, n, vp, vn, score, at = (x[keep] for x in (start_a, start_b, m, n, vp, vn, score, at))
                k = int(np.searchsorted(-n, -j, side="left"))
                if not k:
                    break
        c = points[start_b[:k] + j]
        rows = across_band + j
        same = (points[np.minimum(start_a[:k, None] + rows, last)] == c[:, None]) & (rows < m[:k, None]) & (rows >= 0)
        match = (same * bits).sum(axis=1, dtype=np.uint64)
        p, q = vp[:k], vn[:k]
        d0 = ((((match & p) + p) ^ p) | match | q) & full
        hp = (q | ~(d0 | p)) & full
        hn = d0 & p
        beyond = j + edits >= m[:k]  # the band's lower edge has left the matrix: follow the last row instead
        spot = np.where(beyond, m[:k] - 1 - j + edits, 2 * edits).astype(np.uint64)
        diagonal = 1 - ((d0 >> spot) & one).astype(np.int64)
        across = ((hp >> spot) & one).astype(np.int64) - ((hn >> spot) & one).astype(np.int64)
        score[:k] += np.where(beyond, across, diagonal)
        vp[:k] = (hn | ~((d0 >> one) | hp)) & full
        vn[:k] = (d0 >> one) & hp
    out[at] = score <= edits
    return out
