"""Text metrics (F3–F13) as Column builders.

Edit distance counts Unicode code points, like Python's ``Levenshtein``.
Two implementations, chosen per job (never per row):

* ``native`` — Catalyst ``levenshtein``. Equal strings short-cut to 0; otherwise
  a banded run (``levenshtein(a, b, t)``, O(n·t)) is tried with a band that
  covers typical noise levels, and only rows whose distance exceeds the band
  pay for the full quadratic run. Exact for every row.
* ``arrow`` — an Arrow-batched pandas UDF: texts of one length that differ in
  few places along a band of diagonals, many pairs at once with numpy; others by
  the bit-parallel method (Myers 1999, Hyyrö 2003), O(n·m/w) with Python integers
  as bit vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col_, py_strip, words_joined


def bitparallel_distance(a: str, b: str) -> int:
    """Levenshtein distance of two strings by bit-parallel column updates."""
    if a == b:
        return 0
    if len(a) > len(b):  # a step for each character of the shorter text, a bit for each of the longer
        a, b = b, a
    m = len(b)
    if not a:
        return m
    masks: dict[str, int] = {}
    bit = 1
    for ch in b:
        masks[ch] = masks.get(ch, 0) | bit
        bit <<= 1
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    for ch in a:
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) & full) ^ pv) | eq
        ph = mv | (full ^ (xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (full ^ (xv | ph))
        mv = ph & xv
    return score


BANDED_ROWS = 256  # pairs of one banded run
BANDED_LEAST = 64  # characters of the shorter text from which a pair is worth it


def _core(a: str, b: str) -> tuple[str, str]:
    """Both texts without their common start and end, which cost nothing."""
    x, y = _points(a), _points(b)
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    first = int(other[0]) if len(other) else n
    other = np.flatnonzero(x[first:][::-1][: n - first] != y[first:][::-1][: n - first])
    last = int(other[0]) if len(other) else n - first
    return a[first : len(a) - last], b[first : len(b) - last]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def distances(a: list[str | None], b: list[str | None]) -> list[int | None]:
    """Levenshtein distances of pairs; null beside a null text.

    A path that leaves the diagonals -k..k takes at least 2k + 2 - d steps, with
    d the difference of the lengths. Texts of one length are apart by the places
    where they differ at most, so half as many diagonals hold their best path;
    such pairs run side by side, ``BANDED_ROWS`` at a time. The others, and those
    whose band is no narrower than the texts, take the bit-parallel method."""
    out: list[int | None] = [None] * len(a)
    banded = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None:
            continue
        if x == y:
            out[i] = 0
            continue
        x, y = _core(x, y)
        if len(x) == len(y) >= BANDED_LEAST:
            p, q = _points(x), _points(y)
            k = int(np.count_nonzero(p != q)) // 2
            if 4 * k < len(x):
                banded.append((k, len(p), i, p, q))
                continue
        out[i] = bitparallel_distance(x, y)
    banded.sort(key=lambda r: r[:3])
    for first in range(0, len(banded), BANDED_ROWS):
        some = banded[first : first + BANDED_ROWS]
        for (_, _, i, _, _), d in zip(some, _banded([r[3] for r in some], [r[4] for r in some], some[-1][0]).tolist(), strict=True):
            out[i] = d
    return out


def _banded(a: list[np.ndarray], b: list[np.ndarray], k: int) -> np.ndarray:
    """Distances of pairs of one length each along the diagonals -k..k: the
    matrices' anti-diagonals one after the other, all pairs at once. The distance
    of a pair of length n is on anti-diagonal 2n, on diagonal 0."""
    rows, pad = len(a), k + 2
    sizes = np.array([len(x) for x in a])
    most = int(sizes.max())
    x, y = np.full((most + 2 * pad, rows), -1, np.int32), np.full((most + 2 * pad, rows), -2, np.int32)
    for r, (p, q) in enumerate(zip(a, b, strict=True)):
        x[pad : pad + len(p), r], y[pad : pad + len(q), r] = p, q
    ends: dict[int, np.ndarray] = {n: np.flatnonzero(sizes == n) for n in np.unique(sizes).tolist()}
    out = np.zeros(rows, np.int64)
    # the cells (i, j) of anti-diagonal s = i + j lie on the diagonals j - i of the same parity as s
    kind, far = (np.int16, 1 << 14) if most <= 4000 else (np.int32, 1 << 29)  # an anti-diagonal adds 1 at most
    diagonals = [np.arange(-k + ((k + parity) & 1), k + 1, 2) for parity in (0, 1)]  # even, odd
    last = [np.full((len(d), rows), far, kind) for d in diagonals]  # the latest anti-diagonal of each parity
    last[0][np.flatnonzero(diagonals[0] == 0)] = 0
    zero = int(np.flatnonzero(diagonals[0] == 0)[0])
    for s in range(1, 2 * most + 1):
        own, other = s & 1, 1 - (s & 1)
        d = diagonals[own]
        if not len(d):
            continue
        j = (s + int(d[0])) // 2  # of the lowest diagonal; on the next, i is one less and j one more
        i = s - j
        at = pad + i - 1
        new = last[own] + (x[at - len(d) + 1 : at + 1][::-1] != y[pad + j - 1 : pad + j - 1 + len(d)])
        beside = last[other] + 1
        if len(diagonals[other]):
            shift = int(diagonals[other][0]) < int(d[0])  # whether the other parity starts one lower
            low, high = (beside[:-1], beside[1:]) if shift else (beside, beside)
            if shift:
                np.minimum(new[: len(high)], high[: len(new)], out=new[: len(high)])
                np.minimum(new[: len(low)], low[: len(new)], out=new[: len(low)])
                if len(beside) == len(d):  # the top diagonal has a neighbour below only
                    np.minimum(new[-1], beside[-1], out=new[-1])
            else:
                m = min(len(new), len(high))
                np.minimum(new[:m], high[:m], out=new[:m])
                np.minimum(new[1 : m + 1], low[: len(new) - 1], out=new[1 : m + 1])
        last[own] = new
        if not own and s // 2 in ends:
            of = ends[s // 2]
            out[of] = new[zero, of]
    return out


@F.pandas_udf(T.LongType())
def _distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(distances(a.tolist(), b.tolist()), dtype="Int64")


@F.pandas_udf(T.StructType([T.StructField("d", T.LongType()), T.StructField("wd", T.LongType())]))
def _two_distances_udf(p: pd.Series, e: pd.Series, pw: pd.Series, ew: pd.Series) -> pd.DataFrame:
    a, b, x, y = (c.tolist() for c in (p, e, pw, ew))
    d = distances(a, b)
    wd = [raw if x[i] == a[i] and y[i] == b[i] else None for i, raw in enumerate(d)]
    other = [i for i, raw in enumerate(d) if raw is not None and wd[i] is None]
    for i, far in zip(other, distances([x[i] for i in other], [y[i] for i in other]), strict=True):
        wd[i] = far
    return pd.DataFrame({"d": pd.Series(d, dtype="Int64"), "wd": pd.Series(wd, dtype="Int64")})


def with_two_distances(df: DataFrame, p: str, e: str, pw: str, ew: str, out_d: str = "_d",
                       out_wd: str = "_wd", impl: str = "native") -> DataFrame:
    """Distance of the raw texts and of their normalised forms, each once.

    ``arrow``: one pandas UDF call per batch computes both, the second only
    where normalisation changed a text. ``native``: two staged projections.
    """
    if impl == "arrow":
        both = df.withColumn("_dd", _two_distances_udf(F.col(p), F.col(e), F.col(pw), F.col(ew)))
        return both.select("*", F.col("_dd.d").alias(out_d), F.col("_dd.wd").alias(out_wd)).drop("_dd")
    s1 = with_edit_distance(df, p, e, out_d, impl)
    return s1.withColumn(out_wd, F.when((F.col(pw) == F.col(p)) & (F.col(ew) == F.col(e)), F.col(out_d))
                         .otherwise(edit_distance(pw, ew, impl)))


def edit_distance(a: Column | str, b: Column | str, impl: str = "native") -> Column:
    """Levenshtein distance in code points (bigint); null if either is null.

    The banded result is bound once per row (through a one-element
    ``transform``) so it is never evaluated twice, and the full quadratic run
    happens only when the band was too narrow.
    """
    a, b = col_(a), col_(b)
    if impl == "arrow":
        return F.when(a == b, F.lit(0).cast("bigint")).otherwise(_distance_udf(a, b))
    if impl != "native":
        raise ValueError(f"unknown edit-distance impl {impl!r}")
    la, lb = F.length(a), F.length(b)
    band = F.abs(la - lb) + F.greatest(F.lit(16), F.ceil(F.greatest(la, lb) * 0.2).cast("int"))
    d_band = F.call_function("levenshtein", a, b, band)
    exact = F.element_at(
        F.transform(F.array(d_band), lambda d: F.when(d >= 0, d).otherwise(F.levenshtein(a, b))), 1)
    return F.when(a == b, F.lit(0)).otherwise(exact).cast("bigint")


def with_edit_distance(df: DataFrame, a: str, b: str, out: str, impl: str = "native") -> DataFrame:
    """``df`` plus column ``out`` = edit distance of columns ``a`` and ``b``.

    A separate projection: later metrics referencing ``out`` several times
    read the value instead of re-running the distance (Catalyst does not
    collapse a projection whose non-trivial output is referenced twice).
    """
    return df.withColumn(out, edit_distance(a, b, impl))


def exact_match(pred: Column | str, expected: Column | str) -> Column:
    """equality after stripping both sides, as int 0/1."""
    return (py_strip(pred) == py_strip(expected)).cast("int")


def char_accuracy(distance: Column, n_expected: Column) -> Column:
    """``(n-d)/n``; 0 when the expected text is empty; may be negative."""
    return F.when(n_expected > 0, (n_expected - distance) / n_expected).otherwise(F.lit(0.0))


def cer_eval(distance: Column, n_expected: Column) -> Column:
    """``d/n``; 0 when the expected text is empty; may exceed 1."""
    return F.when(n_expected > 0, distance / n_expected).otherwise(F.lit(0.0))


def cer_reward(distance: Column, n_expected: Column) -> Column:
    """``d/max(n,1)``."""
    return distance / F.greatest(n_expected, F.lit(1))


def word_accuracy(pred: Column | str, expected: Column | str, *, guard: str = "expected",
                  impl: str = "native", raw_distance: Column | None = None) -> Column:
    """Character distance of whitespace-normalised texts over the longer one.

    ``guard="expected"`` (evaluation): 0 when the expected text has no words.
    ``guard="both"`` (reward): 0 only when both normalised texts are empty.
    ``raw_distance`` lets a caller reuse an already computed distance of the
    raw texts when normalisation changes neither side.
    """
    p, e = col_(pred), col_(expected)
    pw, ew = words_joined(p), words_joined(e)
    wd = edit_distance(pw, ew, impl)
    if raw_distance is not None:
        wd = F.when((pw == p) & (ew == e), raw_distance).otherwise(wd)
    longest = F.greatest(F.length(pw), F.length(ew))
    value = 1 - wd / longest
    if guard == "expected":
        return F.when(F.length(ew) > 0, value).otherwise(F.lit(0.0))
    return F.when(longest > 0, value).otherwise(F.lit(0.0))


def positional_matches(a: Column | str, b: Column | str) -> Column:
    """equal characters at equal positions over the shorter text (bigint).

    ``split(s, '')`` yields ``['']`` for an empty string, so empty inputs are
    guarded explicitly.
    """
    a, b = col_(a), col_(b)
    eq = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    n = F.size(F.filter(eq, lambda z: z))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(n).cast("bigint")


def length_ratio(pred: Column | str, expected: Column | str) -> Column:
    """``len(pred)/max(len(expected),1)``."""
    return F.length(col_(pred)) / F.greatest(F.length(col_(expected)), F.lit(1))


METRIC_SENTINEL = {"exact_match": 0, "char_accuracy": 0.0, "word_accuracy": 0.0, "cer": 1.0, "char_distance": 999}


def typo_metrics(pred: Column | str, expected: Column | str, impl: str = "native") -> list[Column]:
    """F3–F10 as named Column expressions (convenient for small inputs; the
    DataFrame operator ``score_frame`` computes each distance only once).

    A null prediction or expected text yields the failure sentinel
    ``(0, 0.0, 0.0, 1.0, 999)``.
    """
    p, e = col_(pred), col_(expected)
    d = edit_distance(p, e, impl)
    wd = F.when((words_joined(p) == p) & (words_joined(e) == e), d).otherwise(
        edit_distance(words_joined(p), words_joined(e), impl))
    return _metric_record(p, e, d, wd)


def _metric_record(p: Column, e: Column, d: Column, wd: Column,
                   pw: Column | None = None, ew: Column | None = None) -> list[Column]:
    n = F.length(e)
    pw = words_joined(p) if pw is None else pw
    ew = words_joined(e) if ew is None else ew
    longest = F.greatest(F.length(pw), F.length(ew))
    wacc = F.when(F.length(ew) > 0, 1 - wd / longest).otherwise(F.lit(0.0))
    failed = p.isNull() | e.isNull()
    s = METRIC_SENTINEL
    return [
        F.when(failed, F.lit(s["exact_match"])).otherwise(exact_match(p, e)).cast("int").alias("exact_match"),
        F.when(failed, F.lit(s["char_accuracy"])).otherwise(char_accuracy(d, n)).cast("double").alias("char_accuracy"),
        F.when(failed, F.lit(s["word_accuracy"])).otherwise(wacc).cast("double").alias("word_accuracy"),
        F.when(failed, F.lit(s["cer"])).otherwise(cer_eval(d, n)).cast("double").alias("cer"),
        F.when(failed, F.lit(s["char_distance"])).otherwise(d).cast("bigint").alias("char_distance"),
    ]


def score_frame(df: DataFrame, pred: str, expected: str, keep: list[str], impl: str = "native") -> DataFrame:
    """F3–F10 over a DataFrame in stages: raw distance, then the distance of
    whitespace-normalised texts (reusing the raw one when normalisation
    changes nothing), then the metric record from the stored distances."""
    p, e = F.col(pred), F.col(expected)
    s1 = df.select(*keep, p.alias("_p"), e.alias("_e"))
    s2 = s1.select("*", words_joined("_p").alias("_pw"), words_joined("_e").alias("_ew"))
    s3 = with_two_distances(s2, "_p", "_e", "_pw", "_ew", impl=impl)
    return s3.select(*keep, *_metric_record(F.col("_p"), F.col("_e"), F.col("_d"), F.col("_wd"),
                                            F.col("_pw"), F.col("_ew")))
