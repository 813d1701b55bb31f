"""Spelling variants: words one edit apart, found on a bit-sliced position index.

Words are counted over all documents; those long and frequent enough are the
vocabulary. One edit spares the first ``HALF`` letters of both words or the last
``HALF``, so each word goes to the region of its first and to that of its last
letters, and every pair meets in one: pairs with equal first letters count in the
first kind of region only, all others in the second.

Inside a region, for every (position, letter) a bitset over the region's words
tells which have that letter there. For a query word the recurrence runs along
its letters and holds four bitsets over all words at once: those equal so far,
and those with one letter replaced, one more (compared with the next position)
or one less (compared with the position before). At the end the word's length
picks the answers. Queries of one length run side by side.

A region of more than ``BLOCK`` words is parted by a hash: each part indexes its
own words and gets all the region's words as queries. Small regions share an
index. A task holds one index and one block of queries.

A word's form is its near word of largest count, ties by code point, where that
count is at least ``RATIO`` times its own; roots follow forms, by doubling.

Defined results: a null or empty text has no words; a null doc_id draws errors
as an empty one; rows that repeat a doc_id each count; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumble.llm.shared import keep, with_package
from fumble.llm.tokens import ragged
from fumble.llm.url_filter import LOWER, UPPER

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
HALF = LEAST_LETTERS // 2
ERRORS = 199  # one run in so many loses a letter
BLOCK, QUERIES = 4096, 512  # words of an index, queries that run side by side
NEAR = "word string, n_near long, near_n long, near string"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS) -> DataFrame:
    """(word) for every run of letters; runs that crc32 of id and run picks lose a letter."""
    text = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    name = F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"))
    rows = docs.select(name.alias("name"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("name", "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return rows.select(F.when(F.pmod(h, F.lit(errors)) == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(found: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    return found.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


class PositionIndex:
    """Bitsets over ``words`` by (position, letter)."""

    def __init__(self, words: list[str]):
        flat, self.sizes = _letters(words)
        self.width = -(-len(words) // 64)
        self.alphabet, letter = np.unique(flat, return_inverse=True)
        place = ragged(np.zeros(len(words), np.int64), self.sizes)
        keys, row = np.unique(place * len(self.alphabet) + letter, return_inverse=True)
        owner = np.repeat(np.arange(len(words)), self.sizes)
        self.bits = np.zeros((len(keys) + 1, self.width), np.uint64)  # the last row: no word
        np.bitwise_or.at(self.bits, (row, owner >> 6), np.uint64(1) << (owner & 63).astype(np.uint64))
        self.keys = keys
        self.of_length = {int(n): self._set(np.flatnonzero(self.sizes == n)) for n in np.unique(self.sizes)}

    def _set(self, owners: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width, np.uint64)
        np.bitwise_or.at(out, owners >> 6, np.uint64(1) << (owners & 63).astype(np.uint64))
        return out

    def _rows(self, letters: np.ndarray, position: int) -> np.ndarray:
        """For each letter the words that have it at ``position``."""
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        key = position * len(self.alphabet) + at
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.alphabet[at] == letters) & (self.keys[row] == key) & (position >= 0)
        return self.bits[np.where(known, row, len(self.keys))]

    def one_edit(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) exactly one edit apart; ``letters`` has a row per query, all of one length."""
        n, m = letters.shape
        none = np.zeros(self.width, np.uint64)
        same, less = np.tile(~none, (n, 1)), np.zeros((n, self.width), np.uint64)
        other, more = less.copy(), less.copy()
        before, here = self._rows(letters[:, 0], -1), self._rows(letters[:, 0], 0)
        for i in range(m):
            after = self._rows(letters[:, i], i + 1)
            more = (more | same) & after
            less = (less & before) | same
            other = (other & here) | (same & ~here)
            same = same & here
            if i + 1 < m:
                before, here = self._rows(letters[:, i + 1], i), self._rows(letters[:, i + 1], i + 1)
        found = (other & self.of_length.get(m, none)) | ((more | same) & self.of_length.get(m + 1, none)) | (less & self.of_length.get(m - 1, none))
        some, part = np.nonzero(found)
        bits = np.unpackbits(found[some, part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(bits)
        return some[which], part[which] * 64 + bit


def near_words(words: list[str], counts: np.ndarray, queries: list[str], first_half: bool, half: int = HALF) -> list[tuple]:
    """(query, how many near words, the largest count, its word) over the pairs that this kind of region counts."""
    index = PositionIndex(words)
    flat, sizes = _letters(queries)
    starts = np.cumsum(sizes) - sizes
    names: dict[str, int] = {}
    head = lambda some: np.fromiter((names.setdefault(w[:half], len(names)) for w in some), np.int64, len(some))
    heads, query_heads = head(words), head(queries)
    order, out = np.argsort(sizes, kind="stable"), []
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        for c in range(a, b, QUERIES):
            some = order[c : min(b, c + QUERIES)]
            q, w = index.one_edit(flat[starts[some][:, None] + np.arange(sizes[some[0]])[None, :]])
            q = some[q]
            ok = (query_heads[q] == heads[w]) == first_half
            best: dict[int, tuple] = {}
            number = np.bincount(q[ok], minlength=len(queries))
            for i, j in zip(q[ok].tolist(), w[ok].tolist(), strict=True):
                one = (-int(counts[j]), words[j])
                if i not in best or one < best[i]:
                    best[i] = one
            out += [(queries[i], int(number[i]), -n, word) for i, (n, word) in best.items()]
    return out


def near_counts(known: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near): how many words are near, and the first of them by count, then code point."""
    with_package(known.sparkSession)
    ends = F.array(F.struct(F.lit(True).alias("head"), F.substring("word", 1, HALF).alias("key")), F.struct(F.lit(False).alias("head"), F.expr(f"right(word, {HALF})").alias("key")))
    rows = known.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.head", "e.key")
    # regions above a block: at most 2 * words / block rows; written, so Spark knows their size and joins by it
    large = keep(rows.groupBy("head", "key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts")).filter("parts > 1"), "spelling-large")
    rows = rows.join(large, ["head", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    words = rows.select("head", "key", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "word", "n")
    asks = rows.select("head", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "word", "n")
    dealt = words.unionByName(asks).repartition("head", "key", "part").sortWithinPartitions("head", "key", "part", "asks", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, queries, last = [], [], [], None

        def answered() -> pa.RecordBatch:
            got = near_words(words, np.array(counts, np.int64), queries, last[0]) if words and queries else []
            queries.clear()
            cols = zip(*got, strict=True) if got else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "near_n", "near"])

        for b in batches:
            for *region, asks, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if region != last:
                    if last is not None and (len(words) >= block // 2 or region[0] != last[0]):
                        yield answered()
                        words, counts = [], []
                    last = region
                if asks:
                    queries.append(word)
                    if len(queries) >= block:  # its region's words have all come
                        yield answered()
                else:
                    words.append(word)
                    counts.append(n)
        if last is not None:
            yield answered()

    found = dealt.mapInArrow(run, NEAR)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("first.less")).alias("near_n"), F.col("first.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): counts grow along forms, so each round halves what is left of the longest way."""
    state = keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if state.join(on, "root", "left_semi").isEmpty():
            return state
        state = keep(state.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """One row per word of the vocabulary: word, n, n_near, form, form_n, root."""
    known = keep(vocabulary(occurrences(docs, id_col, text_col)), "spelling-words")
    near = known.join(near_counts(known, block), "word", "left")
    has: Column = F.col("near_n") >= ratio * F.col("n")
    formed = keep(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "spelling-forms")
    found = roots(formed.filter("form IS NOT NULL"))
    return formed.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
