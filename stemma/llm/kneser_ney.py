"""Character language models with interpolated Kneser-Ney smoothing, for several languages at once.

The n-grams of all languages share one sorted array of 64-bit hashes per order, found by their first
bits; a matrix beside it holds each language's log probability of the n-gram, another the back-off
weight of each context. Hashes are taken over code points, so any character of any script counts. Two
of a million n-grams share a hash with a probability of about 3e-8.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

import numpy as np

ORDER, DISCOUNT = 5, 0.7
_G, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each padded with a blank on both sides; where each begins; and how many
    characters of its own text stand before each."""
    padded = [f" {t} " for t in texts]
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(p) for p in padded], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return c, starts, np.arange(len(c)) - np.repeat(starts, lengths)


def _hashes(c: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the hash of the n-gram that ends at each place."""
    out = [c]
    for _ in range(order - 1):
        h = np.zeros_like(c)
        h[1:] = out[-1][:-1]
        out.append(h * _G + c)
    return [h * _MIX for h in out]


def _hash_at(c: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each of some places."""
    h = c[at - (n - 1)]
    for i in range(n - 2, -1, -1):
        h = h * _G + c[at - i]
    return h * _MIX


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and how often it occurs."""
    order = np.argsort(h)
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], order[first], np.diff(first, append=len(s))


class _SortedHashes:
    """Finds hashes in their sorted array: the first bits tell where to begin, a few steps on it is there or not."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there)."""
        at = self.start[(wanted >> self.shift).astype(np.int64)]
        there = self.keys[at]
        todo = np.flatnonzero(there < wanted)
        while len(todo):
            at[todo] += 1
            there[todo] = self.keys[at[todo]]
            todo = todo[there[todo] < wanted[todo]]
        return at, there == wanted


class CharModels:
    """languages: code -> training texts, already normalised (see normal())."""

    def __init__(self, languages: Mapping[str, Iterable[str]], order: int = ORDER, discount: float = DISCOUNT):
        self.codes = sorted(languages)
        self.order = order
        texts = [_codes(list(languages[lang])) for lang in self.codes]
        letters = len(np.unique(np.concatenate([c for c, _, _ in texts]))) if texts else 0
        self.uniform = 1.0 / (letters + 1)
        with ThreadPoolExecutor(4) as pool:  # sorting runs outside the interpreter's lock
            per = list(pool.map(lambda t: self._estimate(t[0], t[2], discount), texts))
        self.keys, self.logp, self.weight = [], [], []
        for n in range(1, order + 1):
            keys, at = np.unique(np.concatenate([p[n - 1][0] for p in per]), return_index=True)
            prefix, suffix = (np.concatenate([p[n - 1][k] for p in per])[at] for k in (2, 3))
            logp = np.full((len(keys), len(per)), np.nan, dtype=np.float32)
            weight = np.zeros((len(keys), len(per)), dtype=np.float32)
            for j, p in enumerate(per):
                logp[np.searchsorted(keys, p[n - 1][0]), j] = p[n - 1][1]
                if n < order:
                    weight[np.searchsorted(keys, p[n][4]), j] = p[n][5]
            if n == 1:
                below = np.float32(np.log(self.uniform * 0.1))
            else:  # an n-gram that only other languages have backs off here, once and for all
                below = self.weight[n - 2][np.searchsorted(self.keys[n - 2], prefix)] + self.logp[n - 2][np.searchsorted(self.keys[n - 2], suffix)]
            self.keys.append(keys)
            self.logp.append(np.where(np.isnan(logp), below, logp))
            self.weight.append(weight)
        self.index = [_SortedHashes(keys) for keys in self.keys]
        # of the longest n-grams, with a last row of zeros for those that aren't there
        self.longest = np.vstack([self.logp[-1], np.zeros((1, len(per)), np.float32)])

    def _estimate(self, c: np.ndarray, into: np.ndarray, d: float) -> list[tuple]:
        """For each order: keys, log probabilities, each key's prefix and suffix; contexts (one shorter) and
        their back-off weights."""
        h = _hashes(c, self.order)
        places, counts = [], []
        for n in range(1, self.order + 1):
            ends = np.flatnonzero(into >= n - 1)
            _, first, k = _distinct(h[n - 1][ends])
            places.append(ends[first])
            counts.append(k)
        result, lower = [], None
        for n in range(1, self.order + 1):
            at, k = places[n - 1], counts[n - 1]
            keys = h[n - 1][at]
            if n < self.order:  # continuation counts: in how many left contexts an n-gram occurs
                longer, contexts_of = np.unique(h[n - 1][places[n]], return_counts=True)
                k = np.ones(len(keys), dtype=np.int64)  # an n-gram that only starts a text
                k[np.searchsorted(keys, longer)] = contexts_of
            prefix = h[n - 2][at - 1] if n > 1 else np.zeros(len(keys), np.uint64)
            suffix = h[n - 2][at] if n > 1 else np.zeros(len(keys), np.uint64)
            contexts, which, kinds = np.unique(prefix, return_inverse=True, return_counts=True)
            totals = np.bincount(which, weights=k, minlength=len(contexts))
            left = d * kinds / totals
            below = np.full(len(keys), self.uniform) if lower is None else np.exp(lower[1][np.searchsorted(lower[0], suffix)])
            logp = np.log((k - d) / totals[which] + left[which] * below)
            result.append((keys, logp, prefix, suffix, contexts, np.log(left)))
            lower = (keys, logp)
        return result

    def scores(self, texts: list[str], block: int = 1 << 18) -> np.ndarray:
        """(len(texts), languages): log probability of each text (padded with a blank on both sides)."""
        out = np.zeros((len(texts), len(self.codes)))
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) < block):
                size += len(texts[end]) + 2
                end += 1
            out[start:end] = self._scores(texts[start:end])
            start = end
        return out

    def _scores(self, texts: list[str]) -> np.ndarray:
        c, starts, into = _codes(texts)
        unseen = np.float32(np.log(self.uniform * 0.1))
        if self.order == 1 or len(c) < self.order:
            lp, todo = np.zeros((len(c), len(self.codes)), dtype=np.float32), np.flatnonzero(into > 0)
        else:  # nearly all n-grams of the highest order are there
            h = c[: 1 - self.order]
            for i in range(1, self.order):
                h = h * _G + c[i : len(c) - self.order + 1 + i]
            at, hit = self.index[-1].find(h * _MIX)
            row = np.full(len(c), len(self.longest) - 1)
            row[self.order - 1 :] = np.where(hit, at, len(self.longest) - 1)
            row[into < self.order - 1] = len(self.longest) - 1
            lp = np.take(self.longest, row, axis=0)
            todo = np.flatnonzero((row == len(self.longest) - 1) & (into > 0))  # the leading blank is given
            self._back_off(lp, c, todo[into[todo] >= self.order - 1], self.order)
        for n in range(self.order - 1, 1, -1):
            reach = into[todo] >= n - 1
            ask = todo[reach]
            at, hit = self.index[n - 1].find(_hash_at(c, ask, n))
            lp[ask[hit]] += self.logp[n - 1][at[hit]]
            self._back_off(lp, c, ask[~hit], n)
            todo = np.concatenate([todo[~reach], ask[~hit]])
        at, hit = self.index[0].find(_hash_at(c, todo, 1))
        lp[todo[hit]] += self.logp[0][at[hit]]
        lp[todo[~hit]] += unseen
        return np.add.reduceat(lp, starts, axis=0)

    def _back_off(self, lp: np.ndarray, c: np.ndarray, at: np.ndarray, n: int) -> None:
        """Adds the weights of the contexts, n - 1 long, before some places."""
        found, hit = self.index[n - 2].find(_hash_at(c, at - 1, n - 1))
        lp[at[hit]] += self.weight[n - 2][found[hit]]
