import re
from collections import Counter

import numpy as np

from fumble.llm import mixing as M
from tests.llm.helpers import corpus, data, frame, with_clashes


def brute_targets(sizes, weights=M.WEIGHTS, cap=M.CAP):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, capped, target = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = left - sum(cap * sizes[s] for s in capped)
        target = {s: cap * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in order}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def sizes_of(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + size(r[1])
    return size, total


def test_sizes_targets_and_caps(spark):
    rows = corpus()
    size, total = sizes_of(rows)
    goal = brute_targets(total)
    got = M.mix(with_clashes(frame(spark, rows)))
    assert data(got, "doc_id", "size", "source_size") == sorted([(r[0], size(r[1]), total[r[3]]) for r in rows], key=repr)
    # floating-point sums of the words may end in another last digit
    want = sorted([(r[0], goal[r[3]]) for r in rows], key=repr)
    assert np.allclose([x[1] for x in data(got, "doc_id", "target")], [x[1] for x in want], rtol=1e-12)
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= M.CAP for r in got.collect())
    assert data(M.mix(frame(spark, rows)), "doc_id", "taken") == data(got, "doc_id", "taken")


def test_taken_words_meet_targets_also_in_small_buckets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), "en", s, 0) for i, (n, s) in enumerate(zip(rng.integers(1, 40, 3000), rng.choice(["a", "b", "c", "d"], 3000, p=[0.1, 0.2, 0.3, 0.4]), strict=True))]
    _, total = sizes_of(rows)
    goal = brute_targets(total)
    for bucket in (M.BUCKET, 7):
        got = {}
        for r in M.mix(frame(spark, rows), bucket=bucket).join(frame(spark, rows).select("doc_id", "source"), "doc_id").collect():
            got[r.source] = got.get(r.source, 0) + r.taken
        for s in goal:
            assert abs(got[s] - goal[s]) <= max(40, 0.002 * goal[s]), (s, got[s], goal[s])


def test_newton_meets_the_entropy_balance(spark):
    """Rates are the capped exponential tilt whose words are the target."""
    cells = spark.createDataFrame([("0a", s, n) for s, n in ((1, 50), (5, 20), (40, 3), (200, 1))], "source string, size long, n long")
    total = 50 + 100 + 120 + 200
    for target in (0.01 * total, 0.5 * total, 1.0 * total, 2.9 * total):
        goals = spark.createDataFrame([("0a", total, float(target))], "source string, source_size long, target double")
        r = M.solve(cells, goals).first()
        words = sum(n * s * min(M.CAP, np.exp(r.lam * s / r.mean)) for s, n in ((1, 50), (5, 20), (40, 3), (200, 1)))
        assert abs(words - target) <= 1e-8 * target


def test_edges(spark):
    assert M.mix(frame(spark, [])).count() == 0
    got = M.mix(frame(spark, [(1, None, "x", "a", 0), (2, "", "x", None, 0)])).collect()
    assert all(r.size == r.taken == 0 for r in got) and len(got) == 2
    rows = [(1, "a b c", "x", "s", 0)] * 5
    assert sum(r.taken for r in M.mix(frame(spark, rows)).collect()) == 15
    assert M.mixed_documents(frame(spark, rows)).count() == 5


def test_rows_that_repeat_an_id_are_taken_as_often_as_the_mix_says(spark):
    rows = [(i, "w " * (3 + i % 5), "en", "ab"[i % 2], 0) for i in range(40)]
    rows += [(d, "x " * (2 + i % 3), "en", "ab"[i % 2], 0) for d in (100, None) for i in range(31)]
    docs = frame(spark, rows)
    want, got = Counter(), Counter()
    for r in M.mix(docs).collect():
        want[r.doc_id, r.size] += r.copies
    for r in M.mixed_documents(docs).collect():
        got[r.doc_id, len(r.text.split())] += 1
    assert got == +want
