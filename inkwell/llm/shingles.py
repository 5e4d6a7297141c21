"""Word shingles as 64-bit hashes, for whole batches of texts at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from inkwell.llm.common import WORD, ship

ship(__name__)

_WORD = re.compile(WORD)
_LOWER = {i: i + 32 for i in range(65, 91)}
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts whose words are hashed at once; a word that is longer is hashed whole.
BLOCK = 1 << 18
_LOWERED = bytes(_LOWER.get(i, i) for i in range(256))
_INSIDE = bytes(i >= 128 or chr(i).isalnum() for i in range(256))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    limit = 300_000

    def __missing__(self, word: str) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_NUMBERS = mix(np.arange(64 * 256, dtype=np.uint64) * _ODD)


def _hashed(raw: bytes, inside: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in lower-case UTF-8, and their hashes: the sum of a number for each byte at its place, mixed.

    inside: 1 for each byte of a word, else 0.
    """
    mark = np.frombuffer(b"\0" + inside + b"\0", np.uint8)
    edge = np.flatnonzero(mark[1:] != mark[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    begin = np.cumsum(length) - length
    letters = np.frombuffer(raw, np.uint8)[mark[1:-1].view(bool)]
    key = ((np.arange(len(letters)) - np.repeat(begin, length)) << 8) + letters
    numbers = _NUMBERS[key] if length.max() <= 64 else mix(key.astype(np.uint64) * _ODD)
    return start, mix(np.add.reduceat(numbers, begin))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after the other, and the bounds of the texts there."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([0] + [len(p) + 1 for p in parts])
    raw = b" ".join(parts).translate(_LOWERED)
    inside = raw.translate(_INSIDE)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        to = inside.rfind(b"\0", at + 1, at + BLOCK) if at + BLOCK < len(raw) else len(raw)
        if to < 0:
            to = inside.find(b"\0", at + BLOCK)
        to = len(raw) if to < 0 else to
        start, hashed = _hashed(raw[at:to], inside[at:to])
        starts.append(start + at)
        hashes.append(hashed)
        at = to
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends)


def shingles(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within each text, and the bounds of the texts there; a shorter text is one run, an empty one has none."""
    have = np.diff(bounds)
    n = np.where(have >= size, have - size + 1, np.minimum(have, 1))
    to = np.concatenate(([0], np.cumsum(n)))
    padded = np.concatenate((h, np.zeros(size, np.uint64)))
    runs = np.full(len(h) + 1, size, np.uint64)
    for i in range(size):
        runs *= _ODD
        runs += padded[i : i + len(runs)]
    out = runs[np.arange(to[-1]) + np.repeat(bounds[:-1] - to[:-1], n)]
    for t in np.flatnonzero((have > 0) & (have < size)):
        run = np.full(1, have[t], np.uint64)
        for i in range(bounds[t], bounds[t + 1]):
            run = run * _ODD + h[i]
        out[to[t]] = run[0]
    return mix(out), to


def counted(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text in order, how often each occurs, and the bounds of the texts there. Sorts s."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))), np.searchsorted(at, bounds)


def digest(h: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of the whole word sequence, as two signed integers."""
    d = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def weighted(texts: list[str | None], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles and their weights, 1 + ln(count), of each text."""
    s, count, bounds = counted(*shingles(*word_hashes(texts), size))
    weight = 1.0 + np.log(count)
    return [(s[a:b], weight[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Exact Jaccard and probability Jaccard of two weighted sets; of two empty ones 0."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    jaccard = len(both) / (len(a[0]) + len(b[0]) - len(both))
    if not len(both):
        return 0.0, 0.0
    wa, wb = a[1][i], b[1][j]
    # sum over common elements of 1 / sum over all z of max(a_z / a_i, b_z / b_i): by r_i = b_i / a_i, z counts a_z if b_z / a_z < r_i
    only_a = a[1].sum() - wa.sum()
    only_b = b[1].sum() - wb.sum()
    order = np.argsort(wb / wa, kind="stable")
    wa, wb = wa[order], wb[order]
    below = np.cumsum(wa)
    above = wb.sum() - np.cumsum(wb)
    return jaccard, float((1.0 / ((only_a + below) / wa + (only_b + above) / wb)).sum())


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> bool:
    """Whether the Jaccard or the probability Jaccard of two weighted sets, sorted by element, is at least the threshold (over 0)."""
    if not len(a[0]) or not len(b[0]):
        return False
    j = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = np.flatnonzero(b[0][j] == a[0])
    if len(i) / (len(a[0]) + len(b[0]) - len(i)) >= threshold:
        return True
    wa, wb = a[1][i], b[1][j[i]]
    # In sum over z of max(a_z / a_i, b_z / b_i) no divisor is over max(a_i, b_i), so the probability Jaccard is at most
    # the common maxima over all that only one has and the larger of both common weights; equal to it for equal weights.
    most = np.maximum(wa, wb).sum() / (a[1].sum() + b[1].sum() - min(wa.sum(), wb.sum()))
    return bool(most >= threshold - 1e-9 and similarity(a, b)[1] >= threshold)
