"""Averaged hashed subword embeddings with a linear softmax, in numpy.

A document's vector is the mean of the vectors of its features: each word, and each
character n-gram of a word between boundary marks, hashed to a bucket. Training is
minibatch stochastic gradient descent on the log loss. All hashing is done on arrays of
code points, whole texts at a time, so time and memory follow the text's length and don't
depend on how many different words there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x100000001B3, -1, 1 << 64))


@cache
def _table(letters: bool) -> np.ndarray:
    """For each code point, whether it belongs to a word."""
    test = str.isalpha if letters else (lambda c: not c.isspace())
    return np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)


def is_letter(codes: np.ndarray) -> np.ndarray:
    return _table(True)[codes]


@dataclass(frozen=True)
class Features:
    """How texts become buckets.

    ``letters``: fold case, and take runs of letters as words; else runs without white space.
    ``words``: the longest word n-gram, 1 or 2. A pair of neighbours is hashed without order, as
    the exclusive or of its words, so that all pairs of a word and itself share a bucket.
    """

    bits: int = 15
    high: int = 3
    letters: bool = False
    words: int = 1

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    def _fold(self, h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * _MIX
        return ((h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(64 - self.bits)).astype(np.int32)

    def of(self, text: str) -> np.ndarray:
        """The bucket of every feature of the text, repeats included."""
        if self.letters:
            text = text.lower()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _table(self.letters)[codes]
        if not inside.any():
            return np.empty(0, np.int32)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        word = np.cumsum(first)
        n = int(inside.sum())
        at = np.arange(n) + word[inside]  # one mark before each word, one at the end
        c = np.zeros(n + int(word[-1]) + 1, np.uint64)
        c[at] = codes[inside].astype(np.uint64) + np.uint64(1)
        mark = c == 0
        out, h = [], c
        for k in range(1, self.high + 1):
            if k > 1:
                h = h[:-1] * _STEP + c[k - 1 :]
            if k == 1:
                whole = ~mark
            else:
                whole = np.ones(len(h), bool)
                for i in range(1, k - 1):
                    whole &= ~mark[i : i + len(h)]
            out.append(self._fold(h[whole], k))
        powers, back = np.full(len(c), _STEP), np.full(len(c), _BACK)
        powers[0] = back[0] = 1
        np.cumprod(powers, out=powers)
        np.cumprod(back, out=back)
        sums = np.cumsum(c * powers)
        edge = np.flatnonzero(mark)
        words = (sums[edge[1:]] - sums[edge[:-1]]) * back[edge[:-1]]
        out.append(self._fold(words, 0))
        if self.words > 1:
            out.append(self._fold(words[1:] ^ words[:-1], self.high + 1))
        return np.concatenate(out)


def bag(text: str, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their shares, which sum to 1; both empty without words."""
    found, n = np.unique(features.of(text), return_counts=True)
    return found, (n / max(1, n.sum())).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, features: Features, dim: int = 8, epochs: int = 8, rate: float = 20.0, batch: int = 16, least_steps: int = 1_500, seed: int = 7) -> dict:
    """Bucket vectors and the output layer. Rows without features teach the bias only.

    Few rows are passed over more often than ``epochs`` times, until ``least_steps`` are made.
    """
    rng = np.random.default_rng(seed)
    e = (rng.standard_normal((features.buckets, dim)) * 0.1).astype(np.float32)
    w = (rng.standard_normal((dim, classes)) * 0.1).astype(np.float32)
    y = np.asarray(labels, np.int64)
    prior = np.bincount(y, minlength=classes) + 1.0
    b = np.log(prior / prior.sum()).astype(np.float32)
    each = max(1, -(-len(bags) // batch))
    epochs = max(epochs, -(-least_steps // each))
    steps, at = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            take = order[k : k + batch]
            now = rate * (1 - at / steps)
            at += 1
            sizes = [len(bags[i][0]) for i in take]
            ids = np.concatenate([bags[i][0] for i in take])
            share = np.concatenate([bags[i][1] for i in take])
            row = np.repeat(np.arange(len(take)), sizes)
            h = np.zeros((len(take), dim), np.float32)
            parts = e[ids] * share[:, None]
            full = [i for i, n in enumerate(sizes) if n]
            if full:
                h[full] = np.add.reduceat(parts, np.cumsum([0, *[sizes[i] for i in full[:-1]]]), axis=0)
            z = h @ w + b
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(take)), y[take]] -= 1
            z /= len(take)
            back = z @ w.T
            w -= now * 0.1 * (h.T @ z)
            b -= now * 0.02 * z.sum(0)
            np.subtract.at(e, ids, now * share[:, None] * back[row])
    return {"scores": (e @ w).astype(np.float32), "bias": b, "features": features}


def logits(text: str, model: dict) -> np.ndarray:
    """The classes' logits; a text without words gets the bias."""
    z = model["bias"].astype(np.float64)
    ids = model["features"].of(text)
    return z + model["scores"][ids].mean(0, dtype=np.float64) if len(ids) else z


def probabilities(text: str, model: dict) -> np.ndarray:
    z = logits(text, model)
    p = np.exp(z - z.max())
    return p / p.sum()
