"""Token ids of whole texts with a public tokenizer file, through a bounded memo.

Both tokenizers split a text where white space starts after another character,
and what stands in one unit never changes the ids of the next. Texts are cut
into such units, known units are looked up, and only new ones are encoded, many
joined in one call, as a call costs more than most units.
The ids equal those of encoding the whole text (tests/llm/test_tokens.py).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from fumble.llm.words import strings

# The characters with the Unicode property White_Space, as a class.
WHITE = "\\x09-\\x0D\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACED = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")  # white space belongs to the unit that it leads
DROPPED = re.compile(f"[^{WHITE}]+")  # white space gives no ids
# A text with any of this is cut by the patterns above, others by splitting at spaces:
# two white characters in a row, one at an end, one that is no space or line end, or no text at all.
_RE2 = re.sub(r"\\u([0-9a-f]{4})|\\x([0-9a-fA-F]{2})", lambda m: "\\x{" + (m[1] or m[2]) + "}", WHITE)
ODD = f"(?s)[{_RE2}][{_RE2}]|^[{_RE2}]|[{_RE2}]$|[{_RE2.replace(chr(92) + 'x{20}', '').replace(chr(92) + 'x{09}-' + chr(92) + 'x{0D}', chr(92) + 'x{09}' + chr(92) + 'x{0B}-' + chr(92) + 'x{0D}')}]|^$"
SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
PUNCTUATION = "!#$%&*+,-./:;=?@^_~"  # none that a special token ends with
MARKS = frozenset(PUNCTUATION)
JOINED = 512  # units in one call
MEMO = 1 << 19  # units held in each Python worker, about 100 MB


class Encoder:
    """Ids of texts; ``memo`` bounds the units that are held."""

    def __init__(self, file: str, unit: re.Pattern, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.tokenizer, self.find, self.most = Tokenizer.from_file(file), unit.findall, memo
        self.glue = " " if unit is DROPPED else ""
        self.bytes_of = None if self.glue else byte_sizes(self.tokenizer)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.hit = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def trim(self) -> None:
        """Hold on to the units that were met again after they were learnt."""
        hit = self.hit[: len(self.at)]  # units stand in the order of their places
        kept, index = list(compress(self.at, hit.tolist())), np.flatnonzero(hit)
        size = self.size[index]
        flat = self.flat[ragged(self.start[index], size)]
        self.forget()
        self.append(kept, flat, size)

    def learn(self, units: list[str]) -> None:
        """Encode new units. A run of ASCII punctuation after a letter has ids of
        its own, so such a unit is put together from two shorter ones, which
        stand in many more."""
        whole, parts = [], []
        for u in units:
            if u[-1:] in MARKS:
                stem = u.rstrip(PUNCTUATION)
                # a letter also in lower case: that of U+0130 ends with a mark
                if stem and stem[-1].isalpha() and stem[-1].lower()[-1].isalpha():
                    parts.append((u, stem, u[len(stem) :]))
                    continue
            whole.append(u)
        shorter = {x for _, stem, run in parts for x in (stem, run) if x not in self.at}
        self.encode_new(list(shorter.difference(whole)) + whole)
        if parts:
            names, stems, runs = zip(*parts, strict=True)
            index = np.fromiter(chain.from_iterable(zip(map(self.at.__getitem__, stems), map(self.at.__getitem__, runs), strict=True)), np.int64, 2 * len(parts))
            size = self.size[index]
            self.append(list(names), self.flat[ragged(self.start[index], size)], size[::2] + size[1::2])

    def encode_new(self, units: list[str]) -> None:
        """Encode units, many in one call. A unit has the same ids among others if
        white space stands before it and it ends without any."""
        joined, alone = units, []
        if not self.glue:
            fits = [u[0] in SPACES and u[-1] not in SPACES for u in units]
            alone = list(compress(units, map(not_, fits)))
            joined = list(compress(units, fits)) if alone else units
        if alone:
            self.add(alone, [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)])
        for first in range(0, len(joined), JOINED * 64):
            some = joined[first : first + JOINED * 64]
            groups = [some[i : i + JOINED] for i in range(0, len(some), JOINED)]
            texts = [self.glue.join(g) for g in groups]
            if self.bytes_of is None:
                encoded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            else:  # ids tell their places themselves
                encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for group, text, e in zip(groups, texts, encoded, strict=True):
                ids = np.array(e.ids, np.uint32)
                if self.bytes_of is None:
                    sizes = np.fromiter(map(len, group), np.int64, len(group)) + len(self.glue)
                    places = np.fromiter([o for o, _ in e.offsets], np.int64, len(ids))
                else:
                    sizes = np.fromiter(map(len, group if text.isascii() else map(str.encode, group)), np.int64, len(group))
                    places = np.cumsum(self.bytes_of[ids]) - self.bytes_of[ids]
                per_unit = np.bincount(np.searchsorted(np.cumsum(sizes), places, "right"), minlength=len(group))
                self.append(group, ids, per_unit)

    def add(self, units: list[str], got: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.append(units, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes)

    def append(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        first, last = len(self.at), len(self.at) + len(units)
        self.at.update(zip(units, range(first, last), strict=True))
        while last > len(self.start):
            self.start, self.size, self.hit = (np.concatenate([a, np.zeros(max(1024, len(a)), a.dtype)]) for a in (self.start, self.size, self.hit))
        self.start[first:last], self.size[first:last] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def places(self, units: list[str]) -> np.ndarray:
        """Where the units stand in the memo; new ones are learnt."""
        index = np.fromiter(map(self.at.get, units, repeat(-1)), np.int64, len(units))
        self.hit[index[index >= 0]] = True
        if len(new := np.flatnonzero(index < 0)):
            missing = [units[i] for i in new]
            self.learn(list(dict.fromkeys(missing)))
            index[new] = np.fromiter(map(self.at.__getitem__, missing), np.int64, len(new))
        return index

    def plain_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places of all units, units of each text) of texts whose white space is
        single spaces and line ends between other characters. Each distinct word
        of the batch is looked up once."""
        spaced = pc.replace_substring(texts, "\n", " " if self.glue else " \n")
        lists = pc.split_pattern(spaced, " ")
        starts = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, np.asarray(coded.indices)
        units = words if self.glue else pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise("", words, " "))
        index = self.places(strings(units))[codes]
        if not self.glue:  # a text's first word has no space in front
            first = starts[:-1] - starts[0]
            index[first] = self.places(strings(words.take(pa.array(codes[first]))))
        return index, np.diff(starts)

    def odd_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        units = [self.find(t) for t in texts]
        return self.places(list(chain.from_iterable(units))), np.fromiter(map(len, units), np.int64, len(units))

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, number of ids of each text)."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        if len(self.at) > self.most:
            self.trim()
            if len(self.at) > self.most // 2:
                self.forget()
        odd = np.asarray(pc.match_substring_regex(texts, ODD).cast(pa.uint8())).astype(bool)
        where = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        parts = [f(texts.filter(pa.array(m))) for f, m in ((self.plain_units, ~odd), (lambda x: self.odd_units(x.to_pylist()), odd)) if m.any()]
        index = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int64)
        counts, firsts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if parts:
            counts[where] = got = np.concatenate([c for _, c in parts])
            firsts[where] = np.cumsum(got) - got
            index = index[ragged(firsts, counts)]  # back in the order of the texts
        return self.ids_at(index, counts)

    def encode_words(self, words: list[str], codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, of texts given by distinct words, every word's code and
        the words of each text; for tokenizers that drop white space."""
        if len(self.at) > self.most:
            self.trim()
            if len(self.at) > self.most // 2:
                self.forget()
        return self.ids_at(self.places(words)[codes], counts)

    def ids_at(self, index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[index]
        ids = self.flat[ragged(self.start[index], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


def byte_sizes(tokenizer: Tokenizer) -> np.ndarray:
    """How many bytes of a text each id of a byte-level tokenizer stands for: a
    character of its name is one byte, but an added token is named by its text."""
    named = tokenizer.get_vocab()
    out = np.zeros(max(named.values()) + 1, np.int64)
    for name, i in named.items():
        out[i] = len(name)
    for i, token in tokenizer.get_added_tokens_decoder().items():
        out[i] = len(token.content.encode())
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of each run, run after run."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=4)
def encoder(file: str, drops_space: bool, memo: int = MEMO) -> Encoder:
    """The worker's encoder of a file; it lives as long as the worker."""
    return Encoder(file, DROPPED if drops_space else SPACED, memo)


def slices(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of a column of about ``most`` bytes each."""
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right"))
        last = max(first + 1, last)
        yield first, last - first
        first = last
