"""Runs: maximal stretches of words that repeat with a period, and their removal.

A run has smallest period q, at least max(``LEAST``, 2q) words, and no neighbour
extends it. Texts of a batch lie in one array, a word of its own after each, so
that no run passes from one to the next; 64-bit hashes of all stretches of 2^j
words (each made of two halves) compare stretches and extend pairs.

Periods below ``SCALE`` are found by direct scans, one a lag. For longer ones,
every scale W = 32, 64, ... has periods W to 2W. Of the hashes of W/8 words the
minima of all windows of W/2 places are taken. In a run of period q a window's
copy q words on has the same content, so its minima lie q apart: pairs of equal
minima at distance W to 2W are seeds, which are extended to both sides.

Inside a run of a short period p (at most W/16) the same minimum comes back every
p words, and pairs would grow with the square of its length. So places inside
such a run, found already at a smaller scale, are no minima but at its two ends.
Then a run of period q escapes only if each of its two halves lies (but for W/16
words at its ends) in a run of the same short period, A and B. Either an end of
A maps to that end of B, which gives q, or the halves lie wholly within them and
A and B touch; then q is one of the lags at which their roots agree. These seeds
are added for neighbouring runs of one period. So the seeds grow in proportion
to the words, the answer is whole, and a run found at several lags (multiples of
its period) keeps the smallest.

Documents are judged each on its own in the task that reads them; memory grows
with the longest text only.

Defined results: a null or empty text and one of white space have no runs; rows
that repeat a doc_id, or have none, are judged each on its own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumble.llm.shared import with_package, words
from fumble.llm.tokens import ragged, slices
from fumble.llm.words import word_codes

LEAST = 12
SCALE = 32  # the smallest scale; shorter periods are scanned lag by lag
PART = 1 << 22  # bytes of text at a time
PLANTED = 10  # every tenth document, by crc32, is made periodic by ``with_repeats``
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start: long, length: long, period: long>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def _levels(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the 2^j words from each place on; where less is left, a value of its own."""
    levels, width = [_mixed((codes.astype(np.uint64) + np.uint64(1)) * _A)], 1
    while 2 * width <= longest:
        h, n = levels[-1], len(codes) - width
        alone = np.arange(n, len(codes)).astype(np.uint64) + (np.uint64(len(levels) + 1) << np.uint64(48))
        levels.append(np.concatenate([_mixed(_mixed(h[:n] * _A) + h[width:]), _mixed(alone * _A)]))
        width *= 2
    return levels


def _extended(levels: list[np.ndarray], i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of the stretch around each ``i`` that equals the one ``d`` words on."""
    n = len(levels[0])
    right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        h, width = levels[j], 1 << j
        a = i + right
        b = a + d
        right += width * ((b < n) & (h[np.minimum(a, n - 1)] == h[np.minimum(b, n - 1)]))
        a = i - left - width
        b = a + d
        left += width * ((a >= 0) & (h[np.maximum(a, 0)] == h[np.clip(b, 0, n - 1)]))
    return i - left, left + right


def _lag_runs(levels: list[np.ndarray], lag: int) -> np.ndarray:
    """Stretches of at least ``lag`` words that equal those ``lag`` words on, as rows (start, length, period)."""
    j = lag.bit_length() - 1
    h = levels[j]
    at = np.flatnonzero(h[:-lag] == h[lag:])
    if not len(at):
        return np.zeros((0, 3), np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    length = np.diff(np.append(new, len(at))) + (1 << j) - 1
    ok = length >= lag
    return np.stack([at[new][ok], length[ok] + lag, np.full(ok.sum(), lag)], 1)


def _primitive(runs: np.ndarray) -> np.ndarray:
    """Distinct runs by start and period; of one stretch, the one with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _minima(values: np.ndarray, window: int) -> np.ndarray:
    """Whether each value is the least of some window of ``window`` places around it."""
    least, width = values.copy(), 1
    while width < window:
        least[:-width] = np.minimum(least[:-width], least[width:])
        width *= 2
    most, width = least, 1
    while width < window:
        most = np.concatenate([most[:width], np.maximum(most[width:], most[:-width])])
        width *= 2
    return (values == most) & (values != _MOST)


def _inside(runs: np.ndarray, k: int, n: int) -> np.ndarray:
    """Places whose ``k`` words lie a period away from both ends of a run."""
    first, last = runs[:, 0] + runs[:, 2], runs[:, 0] + runs[:, 1] - k - runs[:, 2]
    ok = last >= first
    edges = np.bincount(first[ok], minlength=n + 1)[: n + 1].astype(np.int64) - np.bincount(last[ok] + 1, minlength=n + 1)[: n + 1]
    return np.cumsum(edges[:n]) > 0


def _minimum_pairs(levels: list[np.ndarray], places: np.ndarray, known: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal minima at a distance of this scale."""
    k = scale // 8
    h = levels[k.bit_length() - 1]
    short = known[(known[:, 2] <= k // 2) & (known[:, 1] >= k + 2 * known[:, 2])]
    values = np.where(_inside(short, k, len(h)), _MOST, h)[places] if len(short) else h[places]
    at = places[_minima(values, scale // 2)]
    at = at[np.argsort(h[at], kind="stable")]
    value, step = h[at], 1
    starts, lags = [], []
    while step < len(at):  # equal minima that are no inner places are few within 2 * scale words
        apart = at[step:] - at[:-step]
        near = (value[step:] == value[:-step]) & (apart < 2 * scale)
        if not near.any():
            break
        near &= apart >= scale
        starts.append(at[:-step][near])
        lags.append(apart[near])
        step += 1
    return np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*lags, np.zeros(0, np.int64)])


def _junction_pairs(levels: list[np.ndarray], known: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) from neighbouring runs A, B of one short period; see the module's text."""
    g = scale // 16
    runs = known[(known[:, 2] <= g) & (known[:, 1] >= 14 * g)]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    a, b = runs[:-1], runs[1:]
    beside = (a[:, 2] == b[:, 2]) & (b[:, 0] - a[:, 0] - a[:, 1] <= 2 * g)
    a, b = a[beside], b[beside]
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a1, a2, b1, b2, p = a[:, 0], a[:, 0] + a[:, 1], b[:, 0], b[:, 0] + b[:, 1], a[:, 2]
    starts, lags = [a1, a2 - 1], [b1 - a1, b2 - a2]
    touch = np.flatnonzero(b1 <= a2)
    # where in A's first period B's root stands: two hashes of 2^j words cover a period
    which = np.repeat(touch, p[touch])
    root = ragged(a1[touch], p[touch])
    same = np.zeros(len(which), bool)
    for j in np.unique([int(x).bit_length() - 1 for x in p[touch]]):
        here = np.flatnonzero((p[which] >> j) == 1)
        h, w, r = levels[j], which[here], root[here]
        rest = p[w] - (1 << j)
        same[here] = (h[r] == h[b1[w]]) & (h[r + rest] == h[b1[w] + rest])
    which, root = which[same], root[same]
    p_, low, high = p[which], scale, np.minimum(2 * scale - 1, np.minimum(a2 - a1, b2 - b1)[which])
    first = low + (b1[which] - root - low) % p_
    count = np.maximum(0, (high - first) // p_ + 1)
    lag = np.repeat(first, count) + ragged(np.zeros(len(count), np.int64), count) * np.repeat(p_, count)
    owner = np.repeat(which, count)
    start, distance = np.concatenate([*starts, np.maximum(a1[owner], b1[owner] - lag)]), np.concatenate([*lags, lag])
    ok = (distance >= scale) & (distance < 2 * scale) & (start >= 0)
    return start[ok], distance[ok]


def find_runs(codes: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of the texts in ``codes`` (``sizes`` words each, one after the
    other): rows (text, start, length, period) by text, start and period."""
    sizes = np.asarray(sizes, np.int64)
    longest, starts = int(sizes.max(initial=0)), np.cumsum(sizes + 1) - sizes - 1
    if longest < 2:
        return np.zeros((0, 4), np.int64)
    n = int(sizes.sum()) + len(sizes)
    own = np.ones(n, bool)
    own[starts + sizes] = False
    x = np.empty(n, np.int64)
    x[own], x[~own] = codes, np.arange(len(sizes)) + (int(codes.max()) + 1)
    levels = _levels(x, longest)
    known = _primitive(np.concatenate([_lag_runs(levels, lag) for lag in range(1, min(SCALE - 1, longest // 2) + 1)]))
    scale = SCALE
    while 2 * scale <= longest:
        long = sizes >= 2 * scale
        places = ragged(starts[long], sizes[long] + 1)
        pairs = [_minimum_pairs(levels, places, known, scale), _junction_pairs(levels, known, scale)]
        i, d = (np.concatenate(c) for c in zip(*pairs, strict=True))
        if len(i):
            first, length = _extended(levels, i, d)
            ok = length >= d
            known = _primitive(np.concatenate([known, np.stack([first[ok], length[ok] + d[ok], d[ok]], 1)]))
        scale *= 2
    known = known[known[:, 1] >= least]
    text = np.searchsorted(starts, known[:, 0], "right") - 1
    return np.column_stack([text, known[:, 0] - starts[text], known[:, 1:]])


def collapsed(codes: np.ndarray, sizes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays: it stands in no run after that run's first period."""
    starts = np.cumsum(sizes) - sizes
    first = starts[runs[:, 0]] + runs[:, 1]
    edges = np.bincount(first + runs[:, 3], minlength=len(codes) + 1).astype(np.int64) - np.bincount(first + runs[:, 2], minlength=len(codes) + 1)
    return np.cumsum(edges)[: len(codes)] == 0


def _part(ids: pa.Array, texts: pa.Array, least: int) -> pa.RecordBatch:
    names, codes, sizes = word_codes(texts, lower=False)
    runs = find_runs(codes, sizes, least)
    stay = collapsed(codes, sizes, runs)
    kept = np.array(names.to_pylist(), object)[codes[stay]].tolist() if len(codes) else []
    ends = np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    rest = pa.array([" ".join(kept[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
    offsets = np.concatenate([[0], np.cumsum(np.bincount(runs[:, 0], minlength=len(sizes)))])
    rows = pa.StructArray.from_arrays([pa.array(runs[:, c], pa.int64()) for c in (1, 2, 3)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), rest], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period by start, then
    period) and the text without its repeats, words joined by one space."""
    with_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows in slices(b.column(1), PART):
                yield _part(b.column(0).slice(first, rows), b.column(1).slice(first, rows), least)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every tenth document, by the crc32 of its id, repeats a
    stretch of its words from one place on to its end."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    h = F.crc32(doc.cast("string").cast("binary"))

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / PLANTED)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.get(w, F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i).cast("int")))

    # the words are bound once a text by a transform of one element; inside a lambda they would be parted for every place
    made = F.array_join(F.element_at(F.transform(F.array(words(text)), repeated), 1), " ")
    return docs.select(doc.alias("doc_id"), F.when(F.pmod(h, F.lit(PLANTED)) == 0, made).otherwise(text).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """A row per document with its longest run and digests of all its runs and of the rest."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    df = found.withColumn("longest", longest).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period", lines.alias("lines"), "collapsed")
    exponent = F.floor(1000 * F.col("length") / F.col("period")).cast("long")
    return df.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
