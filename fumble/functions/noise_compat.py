"""Keyboard noise with the draws of one shared generator (C3, ``compat``).

The noise of ``noise.py`` draws for each row and character on its own. Here
every text draws from the same sequence, that of Python's generator after
``seed``: each key takes a number below 100, and, where that is at most the
threshold, a number below the count of its neighbours. A number below n takes
the top bits of the next 32-bit word, as many as n has, again and again until
it is below n. So where a draw stands in the sequence depends on all draws
before it, and also on the variants before, which go on in the sequence.

The words are drawn once for each worker and reused by every row. As keys
between two typos only take percent draws, whatever they are, tables over the
words tell from any place how many keys pass until the next typo and where its
draw ends: a text costs a step for each typo, not for each character.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .noise import KEYBOARDS
from .text import col_

PERCENT = 100
FIRST_WORDS = 1 << 16


class Words:
    """The generator's words and, for each place, where the next fitting one is."""

    def __init__(self, seed: int, threshold: int, sizes: tuple[int, ...], count: int):
        raw = random.Random(seed).getrandbits(32 * count).to_bytes(4 * count, "little")
        words = np.frombuffer(raw, "<u4").astype(np.int64)
        percent = words >> (32 - PERCENT.bit_length())
        fits = percent < PERCENT
        self.count, self.passed = count, np.concatenate([[0], np.cumsum(fits)])
        self.typo = self._next(fits & (percent <= threshold))
        self.below = {}
        for n in sizes:
            value = words >> (32 - n.bit_length())
            self.below[n] = (self._next(value < n), value)
        # views of narrow arrays: single reads of an array are slow, and lists hold an object for each number
        places = lambda x: memoryview(x.astype(np.int64 if count > 1 << 30 else np.int32))
        self.passed_by, self.passed, self.typo = self.passed, places(self.passed), places(self.typo)
        self.below = {n: (places(at), memoryview(value.astype(np.uint8))) for n, (at, value) in self.below.items()}

    def _next(self, ok: np.ndarray) -> np.ndarray:
        """The first place from each on where ``ok`` holds; ``count`` if there is none."""
        at = np.where(ok, np.arange(self.count), self.count)
        return np.append(np.minimum.accumulate(at[::-1])[::-1], self.count)


class Compat:
    """Noise of one seed, threshold and keyboard."""

    def __init__(self, seed: int, threshold: int, keyboard: str):
        neighbours = KEYBOARDS[keyboard]
        self.seed, self.threshold = seed, threshold
        self.sizes = tuple(sorted({len(v) for v in neighbours.values()}))
        self.words = Words(seed, threshold, self.sizes, FIRST_WORDS)
        # by code point: the neighbours of keys, and what any other character turns into
        keys = {ord(c): neighbours[c.lower()] for c in map(chr, range(0x110000)) if c.lower() in neighbours}
        self.neighbours = {cp: v if chr(cp).lower() == chr(cp) else v.upper() for cp, v in keys.items()}
        self.is_key = np.zeros(0x110000, bool)
        self.is_key[list(keys)] = True
        self.other = {c: c.lower().upper() for c in map(chr, range(0x110000)) if c.lower() != c and c.lower().upper() != c}
        self.others = frozenset(self.other)

    def texts(self, text: str, variants: int = 1) -> list[str]:
        """``variants`` noisy copies, drawn one after the other."""
        keys = np.flatnonzero(self.is_key[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]).tolist()
        while True:
            out = self._drawn(text, keys, variants)
            if out is not None:
                return out
            self.words = Words(self.seed, self.threshold, self.sizes, 2 * self.words.count)

    def _drawn(self, text: str, keys: list[int], variants: int) -> list[str] | None:
        """None if the words do not suffice."""
        w, place, out = self.words, 0, []
        plain = list(text)
        if not self.others.isdisjoint(plain):
            plain = [self.other.get(c, c) for c in plain]
        for _ in range(variants):
            chars, key = plain.copy(), 0
            while True:
                typo = w.typo[place]
                key += w.passed[typo] - w.passed[place]
                if key >= len(keys):  # the text ends before: its last key's draw is the last one used
                    last = self._after(place, key - (w.passed[typo] - w.passed[place]), len(keys))
                    if last is None:
                        return None
                    place = last
                    break
                if typo >= w.count:
                    return None
                at = keys[key]
                some = self.neighbours[ord(text[at])]
                found, value = w.below[len(some)]
                pick = found[typo + 1]
                if pick >= w.count:
                    return None
                chars[at] = some[value[pick]]
                place, key = pick + 1, key + 1
            out.append("".join(chars))
        return out

    def _after(self, place: int, key: int, keys: int) -> int | None:
        """The place after the percent draws of the keys from ``key`` on, none of them a typo."""
        wanted = self.words.passed[place] + keys - key
        if wanted > self.words.passed[-1]:
            return None
        return int(np.searchsorted(self.words.passed_by, wanted)) if keys > key else place


@lru_cache(maxsize=8)
def compat(seed: int, threshold: int, keyboard: str) -> Compat:
    return Compat(seed, threshold, keyboard)


def keyboard_noise_compat(text: Column | str, prob: float = 0.1, seed: int = 0, keyboard: str = "qwerty", variants: int = 1) -> Column:
    """``array<string>`` of ``variants`` noisy copies; null for a null text. An
    unknown keyboard returns the text unchanged."""
    threshold = int(prob * 100)

    @F.pandas_udf("array<string>")
    def drawn(texts: pd.Series) -> pd.Series:
        if keyboard not in KEYBOARDS:
            return pd.Series([None if t is None else [t] * variants for t in texts.tolist()])
        noise = compat(seed, threshold, keyboard)
        return pd.Series([None if t is None else noise.texts(t, variants) for t in texts.tolist()])

    return drawn(col_(text))
