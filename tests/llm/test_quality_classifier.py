import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fumble.llm import quality_classifier as C
from tests.llm.helpers import corpus, frame, prose, with_clashes


def test_em_recovers_accuracies_of_overlapping_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(50_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7])
    says = np.where(rng.random((len(truth), 4)) < right, truth[:, None], ~truth[:, None])
    votes = np.where(rng.random(says.shape) < 0.7, np.where(says, 1, -1), 0)
    table, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = C.em(table, counts.astype(float))[index.ravel()]
    assert ((post > 0.5) == truth).mean() > 0.93 and abs(post.mean() - truth.mean()) < 0.03


def test_em_with_dependent_labellers():
    """Three labellers of which two copy a third's mistakes, and two of another kind that see the other half of the bad."""
    rng = np.random.default_rng(1)
    n = 100_000
    truth, half = rng.random(n) < 0.95, rng.random(n) < 0.6
    one = ~truth & half & (rng.random(n) < 0.95)
    copy = one & (rng.random(n) < 0.8)
    other = (~truth & ~half & (rng.random(n) < 0.9)) | (truth & (rng.random(n) < 0.003))
    same = other & (rng.random(n) < 0.7)
    votes = np.stack([np.where(one, -1, 0), np.where(copy, -1, 1), np.where(one, -1, 1), np.where(other, -1, 1), np.where(same, -1, 1)], 1)
    table, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good = C.em(table, counts.astype(float))[index.ravel()] > 0.5
    assert (good == truth).mean() > 0.985 and good[truth].mean() > 0.99 and (~good)[~truth].mean() > 0.8
    assert (good == truth).mean() > (~one == truth).mean() + 0.008  # more than the one kind knows


def plain_stems(texts):
    """Of each text: stem -> its distinct words."""
    out = []
    for t in texts:
        cores = {w.lower().rstrip(".,;:") for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
        kinds = {}
        for c in cores:
            if len(c) > 5 and c.isalpha():
                kinds.setdefault(c[:5], set()).add(c)
        out.append((len(cores), kinds))
    return out


def crowd_rows(seed=2):
    """Prose in which a few texts have many words of one stem; copies; a stem that is everywhere."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([20, 60, 120])) + " " + " ".join(f"common{rng.choice('abcdefgh')}" for _ in range(3)), "en", "a", 0) for i in range(300)]
    for i in range(8):
        words = [*prose(rng, 80).split(), *(f"zzyxq{rng.choice('abcdefghijkl')}{rng.choice('abc')}" for _ in range(5))]
        rng.shuffle(words)
        rows.append((1000 + i, " ".join(words), "en", "a", 0))
    copy = prose(rng, 50) + " vwvwva vwvwvb vwvwvc"
    return rows + [(2000 + i, copy, "en", "a", 0) for i in range(40)] + corpus()


def test_crowded_stems_against_brute_force(spark):
    rows = crowd_rows()
    found = plain_stems([r[1] for r in rows])
    numbers = C.read_numbers(frame(spark, rows).select("doc_id", "text"))
    sums = {}
    for _, kinds in found:
        for s, words in kinds.items():
            d, w, m = sums.get(s, (0, 0, 0))
            sums[s] = d + 1, w + len(words), m + len(words) * (len(words) - 1)
    parts = numbers.select(F.explode(F.arrays_zip(*C.OF_PART)).alias("x")).select("x.*")
    got = {r.part_stem: (r.d, r.w, r.m) for r in parts.groupBy("part_stem").agg(F.sum("part_docs").alias("d"), F.sum("part_words").alias("w"), F.sum("part_meets").alias("m")).collect()}
    assert got == {C.stem_key(s): v for s, v in sums.items()}
    total, square = sum(n for n, _ in found), sum(n * n for n, _ in found)
    wide = {s: set().union(*(k.get(s, set()) for _, k in found)) for s in sums}
    want = {s for s, (d, w, m) in sums.items() if m >= C.CROWD * (w / total) ** 2 * square and d >= C.CROWD_DOCS and len(wide[s]) >= C.CROWD_WORDS and m >= 2 * d}
    crowded = {r.stem for r in C.crowded_stems(numbers).collect()}
    assert crowded == {C.stem_key(s) for s in want} and want == {"zzyxq"}
    n_crowd = Counter((r.doc_id, r.n_crowd) for r in C.with_crowds(C.keep(numbers, "crowds-test"), np.array(sorted(crowded))).collect())
    assert n_crowd == Counter((r[0], len(k.get("zzyxq", ())) if len(k.get("zzyxq", ())) > 1 else 0) for r, (_, k) in zip(rows, found, strict=True))


def test_crowds_are_caught_and_copies_left_alone(spark):
    rows = crowd_rows()
    got = {r.doc_id: r for r in C.classify(with_clashes(frame(spark, rows))).collect()}
    several = {r[0] for r, (_, k) in zip(rows, plain_stems([r[1] for r in rows]), strict=True) if len(k.get("zzyxq", ())) > 2}
    assert len(several) == 8 and not any(got[i].kept for i in several)
    left = [got[i].language_score >= 0.5 for i in (*range(300), *range(2000, 2040))]
    assert np.mean(left) > 0.97


def test_toxic_labels_are_followed_beyond_the_list(spark):
    """Over all languages; the list alone finds the listed words only."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    listed = F.lower("text").rlike("|".join(C.LEXICON)).alias("listed")
    got = C.classify(docs).join(labels, "doc_id").join(docs.select("doc_id", "lang", listed), "doc_id").filter("quality = 1").collect()
    right = lambda says: np.mean([says(r) == (r.toxic == 1) for r in got])
    ours, alone = right(lambda r: r.language_score < 0.5), right(lambda r: r.listed)
    found = lambda langs: np.mean([r.language_score < 0.5 for r in got if r.toxic == 1 and r.lang in langs])
    clean = np.mean([r.kept for r in got if r.toxic == 0])
    print(ours, alone, clean, found("en"), found(("de", "es", "fr")))
    assert ours > alone + 0.02 and found(("de", "es", "fr")) > 0.7 and clean > 0.97


def test_scores_follow_given_labels(spark):
    """Labels are used here only, to measure what was learnt without them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = C.classify(docs).join(labels, "doc_id").collect()
    clean = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    bad = [not r.kept for r in got if r.quality == 0]
    assert np.mean(clean) > 0.97 and np.mean(bad) > 0.9
    said = {r.doc_id for r in docs.filter(F.lower("text").rlike("|".join(C.LEXICON))).select("doc_id").collect()}
    toxic = [not r.kept for r in got if r.toxic == 1 and r.doc_id in said]
    assert len(toxic) > 20 and np.mean(toxic) > 0.95


def test_edges(spark):
    rows = corpus()
    got = C.classify(with_clashes(frame(spark, rows))).collect()
    assert sorted((repr(r.doc_id) for r in got)) == sorted(repr(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    assert C.classify(frame(spark, [])).count() == 0
    assert C.classify(frame(spark, [(1, None, "x", "y", 0)])).count() == 1


def test_a_rare_pattern_is_learnt(spark):
    """Bad language in one of thousands of documents, of which a uniform draw would hold none."""
    rng = np.random.default_rng(3)
    text = lambda *more: " ".join([*(f"w{rng.integers(3000)}" for _ in range(40)), *more])
    rows = [(i, text(), "en", "a", 0) for i in range(6000)]
    rare = [(10_000 + i, text("idiot", "scum", "moron"), "en", "a", 0) for i in range(6)]
    got = C.classify(frame(spark, rows + rare), sample=300).collect()
    assert not any(r.kept for r in got if r.doc_id >= 10_000)
    assert np.mean([r.kept for r in got if r.doc_id < 10_000]) > 0.97
