import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fumble.llm import components as CC
from fumble.llm import jaccard_join as J
from fumble.llm.shared import session_with
from tests.llm.helpers import corpus, frame, prose, with_clashes


def sets_of(rows):
    out = []
    for r in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted([(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))], key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in J.jaccard_components(df, **options).collect()), key=repr)


def near_copies(seed, groups, size, words, edits, first=1000):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(rng, words).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((first + len(rows), " ".join(w), "en", "a", 0))
    return rows


def chains(first=5000):
    """Texts that slide along one long text, a few words at a time: components without a centre."""
    rng = random.Random(8)
    base = prose(rng, 600, 10**6).split()
    return [(first + i, " ".join(base[i * 4 : i * 4 + 60]), "en", "b", 0) for i in range(120)]


def passages(first=8000):
    """Unlike texts that share one long passage."""
    rng = random.Random(4)
    shared = prose(rng, 60)
    return [(first + i, prose(rng, rng.choice([3, 12, 30, 80])) + " " + shared, "en", "b", 0) for i in range(150)]


@pytest.mark.parametrize("options", [{}, {"leaf": 2000, "pivots": 4, "block": 3000}, {"leaf": 400, "pivots": 2, "block": 20000}])
def test_components_equal_brute_force(spark, options):
    """Small leaves force Voronoi splits, replicas, recursion and rounds over dense regions."""
    rows = corpus() + near_copies(1, 4, 40, 90, 3) + chains() + passages()
    assert got(with_clashes(frame(spark, rows)), **options) == brute(rows)


def test_threshold_is_exact(spark):
    """Pairs at and beside 80 per cent: unions of 100 and 101 shingles, 80 of them shared."""
    base = [f"w{i}" for i in range(204)]
    rows = []
    for n, (a, b) in enumerate(((90, 90), (90, 91), (80, 100), (80, 101), (100, 80))):
        tag = [f"{n}{w}" for w in base]
        x, y = a - 80, b - 80
        rows.append((2 * n, " ".join([*(f"x{n}_{i}" for i in range(x)), *tag[:84]]), "en", "a", 0))
        rows.append((2 * n + 1, " ".join([*tag[:84], *(f"y{n}_{i}" for i in range(y))]), "en", "a", 0))
    assert got(frame(spark, rows)) == brute(rows)


def test_split_and_rounds_alone(spark):
    rows = near_copies(3, 1, 300, 60, 6)
    assert got(frame(spark, rows), leaf=3000, pivots=3, block=5000) == brute(rows)


def test_region_is_joined_whole_after_a_join(spark):
    """A region whose rows lie in all partitions, with sizes that AQE finds small
    enough to be sent once the rows are dealt, which it then reads as they were."""
    own = session_with(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="10MB")
    sets = [np.arange(100 * (i % 4), 100 * (i % 4) + 50, dtype=np.uint64).tobytes() for i in range(48)]
    members = own.createDataFrame([(7, i, 50, bytearray(s)) for i, s in enumerate(sets)], "region long, number long, n long, shingles binary").repartition(8)
    sized = members.join(members.groupBy("region").agg(F.sum("n").alias("total")), "region")
    found = J.leaf_links(sized.filter("total > 0"), 80)
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()  # an exchange that AQE keeps whole
    links = sorted(tuple(r) for r in found.collect())
    assert links == [(i, i % 4) for i in range(4, 48)]


def regions_of(spark, rows, cap):
    """The sets of rows, and the coarse region of each that has one."""
    sets = list(J.shingle_sets(pa.array([r[1] for r in rows])))
    members = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "number long, n long, shingles binary").repartition(4)
    return sets, {r.node: r.root for r in CC.components(J.coarse_edges(members, 80, cap)).collect()}


def test_a_common_passage_joins_no_regions(spark):
    """Pairs of near copies that all hold one passage: a region each, not one for all."""
    rng = random.Random(5)
    passage, rows = prose(rng, 40, 10**6), []
    for i in range(60):
        own = [f"p{i}w{j}" for j in range(60)]
        rows += [(2 * i, " ".join(own) + " " + passage, "en", "a", 0), (2 * i + 1, " ".join([*own[:-1], "other"]) + " " + passage, "en", "a", 0)]
    for cap in (J.CAP, 10):
        _, regions = regions_of(spark, rows, cap)
        assert regions == {i: i - i % 2 for i in range(120)}


@pytest.mark.parametrize("cap", [1, 2, 7, 256])
def test_no_link_leaves_a_region(spark, cap):
    """Also where shingles of more sets than are counted fill the prefixes."""
    rows = near_copies(2, 3, 30, 80, 4) + chains() + passages()
    sets, regions = regions_of(spark, rows, cap)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if len(a) and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                assert regions[i] == regions[j]


def test_edges(spark):
    assert got(frame(spark, [])) == []
    rows = [(3, None, "x", "y", 0), (2, "", "x", "y", 0), (5, "A b", "x", "y", 0), (4, "a  B", "x", "y", 0), (4, "a b", "x", "y", 0)]
    assert got(frame(spark, rows)) == [(2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4)]
    kept = J.kept_documents(frame(spark, rows[:4])).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [2, 3, 4]


def test_prefix_and_region_join():
    for n in range(1, 200):
        assert n - J.prefix_length(n) + 1 == -(-80 * n // 100) and J.prefix_length(n, 80, J.must_share(n)) <= n
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, 20).astype(np.uint64)) for _ in range(60)]
    root = J.Region(sets, 60).join()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 60 * (len(a) + len(b) - both):
                assert root[i] == root[j]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 3), (9, 3), (5, 5), (7, 6), (6, 7)] + [(500, i) for i in range(501, 600)] + [(550, 9)]
    out = {r.node: r.root for r in CC.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(100, 141)} == {100} and out[1] == out[9] == out[599] == 1 and out[7] == 6 and 5 not in out
    assert CC.components(spark.createDataFrame([], "a long, b long")).count() == 0
