import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fumble.llm import periodic_runs as P
from fumble.llm.queries import op13_periodic_runs
from tests.conftest import SF001
from tests.llm.helpers import corpus, data, frame, prose, with_clashes

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def brute(x, least=12):
    """(start, length, smallest period) of all runs, lag by lag."""
    x, found = np.asarray(x), {}
    for q in range(1, len(x) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s + q >= max(least, 2 * q):
                found.setdefault((s, e - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row(doc, text, planted=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), 1 if doc is None else zlib.crc32(str(doc).encode())
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    names = {v: i for i, v in enumerate(dict.fromkeys(w))}
    found = sorted(brute([names[v] for v in w]), key=lambda r: (r[0], r[2]))
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return doc, len(found), s, m, q, 1000 * m // q if m else None, sha(lines), sha(" ".join(v for i, v in enumerate(w) if i not in drop))


def made(rng):
    kind, n = rng.randrange(7), rng.choice([0, 1, 30, 200, 700])
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [0] * n
    if kind == 2:  # a stretch, some times, between others
        u = [rng.randrange(rng.choice([2, 50])) for _ in range(rng.randrange(1, 200))]
        return [rng.randrange(50) for _ in range(rng.randrange(60))] + u * rng.randrange(2, 5) + [rng.randrange(3) for _ in range(rng.randrange(60))]
    if kind == 3:  # neighbouring runs of one short period
        u = [rng.randrange(2) for _ in range(rng.randrange(1, 5))]
        b = (u * 200)[rng.randrange(5) :][: rng.randrange(2, 150)]
        return b + b[: rng.randrange(len(b) + 1)] + (b if rng.random() < 0.5 else b[::-1]) + [9] * rng.randrange(3)
    if kind == 4:
        m = rng.randrange(1, 120)
        return [w for _ in range(rng.randrange(1, 7)) for w in [0] * (m + rng.choice([0, 0, 1, -1])) + [rng.randrange(1, 3)] * rng.randrange(3)]
    if kind == 5:  # Fibonacci words have very many runs
        a, b = [0], [0, 1]
        while len(b) < n + 2:
            a, b = b, b + a
        return b[rng.randrange(20) :][:n]
    return ([0, 1] * rng.randrange(1, 60) + [0]) * rng.randrange(1, 6)


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_of_made_texts(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [made(rng) for _ in range(rng.randrange(1, 9))]
        got = P.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]))
        assert [tuple(r) for r in got.tolist()] == [(i, s, m, q) for i, t in enumerate(texts) for s, m, q in sorted(brute(t), key=lambda r: (r[0], r[2]))]


def test_seeds_grow_with_the_words():
    for n in (4000, 16000):
        for text in ([0] * n, ([0] * (n // 2 - 1) + [1]) * 2, ([0, 1] * (n // 4) + [0]) * 2):
            x = np.array(text)
            levels = P._levels(x, len(x))
            known = P._primitive(np.concatenate([P._lag_runs(levels, lag) for lag in range(1, P.SCALE)]))
            scale, seeds = P.SCALE, 0
            while 2 * scale <= len(x):
                seeds += sum(len(f[0]) for f in (P._minimum_pairs(levels, np.arange(len(x)), known, scale), P._junction_pairs(levels, known, scale)))
                scale *= 2
            assert seeds <= len(x)
            assert [tuple(r[1:]) for r in P.find_runs(x, np.array([len(x)])).tolist()] == sorted(brute(text), key=lambda r: (r[0], r[2]))


def test_both_kinds_of_seeds_are_needed(monkeypatch):
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    u = [0, 1] * 40 + [0]
    prose_, halves = list(range(100)) * 2, u + u
    whole = lambda t: len(P.find_runs(np.array(t), np.array([len(t)])))
    assert whole(prose_) == len(brute(prose_)) == 1 and whole(halves) == len(brute(halves))
    with monkeypatch.context() as m:
        m.setattr(P, "_minimum_pairs", lambda *a: none)
        assert whole(prose_) == 0
    with monkeypatch.context() as m:
        m.setattr(P, "_junction_pairs", lambda *a: none)
        assert whole(halves) < len(brute(halves))


def test_odd_rows_and_names(spark):
    rng = random.Random(4)
    rows = corpus() + [(200 + i, " ".join(map(str, made(rng))), "en", "a", 0) for i in range(60)]
    rows += [(300, "a " * 20000, "en", "a", 0), (301, (prose(rng, 3000) + "\n") * 3, "en", "a", 0), (302, "a b " * 20, "en", "a", 0), (None, "x y " * 9, "en", "a", 0)]
    df = with_clashes(frame(spark, rows)).selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS period", "4 AS length", "5 AS start", "6 AS longest", "7 AS lines")
    got = data(P.digests(P.periodic_runs(df)), *COLUMNS)
    assert got == sorted((row(r[0], r[1], planted=False) for r in rows), key=repr)


def test_planted_repeats(spark):
    rows = corpus()
    got = data(P.digests(P.periodic_runs(P.with_repeats(with_clashes(frame(spark, rows))))), *COLUMNS)
    assert got == sorted((row(r[0], r[1]) for r in rows), key=repr)


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((row(*r) for r in rows), key=repr)
    assert data(op13_periodic_runs(spark, SF001), *COLUMNS) == want
    assert sum(r[1] > 0 for r in want) > len(rows) // 20


def test_empty_table(spark):
    assert data(P.digests(P.periodic_runs(P.with_repeats(frame(spark, [])))), *COLUMNS) == []
