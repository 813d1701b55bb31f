"""Stage functions on odd tables: repeated and null ids, equal rows, clashing names, removed folders."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fumble.llm import exact_dedup, jaccard_join, mixing, quality_rules, shared
from tests.llm import test_jaccard_join, test_quality_rules
from tests.llm.helpers import corpus, frame, prose

NAMES = ["_id", "_digest", "_sha256", "_stay", "_stratum", "_source", "_size", "_copies", "_copy", "_each", "_rows", "key0", "KEY1", "key2", "rows", "Copies", "place", "copy", "digest", "own", "id", "size", "a.b", "a`b"]
LABELS = "doc_id long, quality int, toxic int"


def stages(spark):
    none = spark.createDataFrame([], LABELS)
    return {
        "quality": lambda docs: quality_rules.kept_documents(docs, none),
        "exact": exact_dedup.kept_documents,
        "near": jaccard_join.kept_documents,
        "mixing": mixing.mixed_documents,
    }


def odd_rows():
    """Rows of one id and of no id, equal rows, near copies under one id."""
    rng = random.Random(12)
    long = prose(rng, 80).split()
    near = [" ".join([*long[:i], "other", *long[i + 1 :]]) for i in (3, 40, 70)]
    rows = corpus() + [(500, near[0], "en", "a", 0), (500, near[1], "en", "b", 0), (499, near[2], "fr", "a", 0), (None, near[0], "en", "a", 0)]
    rows += [(501, prose(rng, 30), "en", "a", 0)] * 3 + [(502, "short", "en", "a", 0)] * 2 + [(None, prose(rng, 25), None, None, 0)] * 2
    return rows


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def key(row):
    return (row[0] is None, row[0] or 0)


def wanted(stage, rows):
    """How many of the rows alike in (doc_id, text) stay."""
    have = Counter((r[0], r[1]) for r in rows)
    if stage == "quality":
        return Counter({k: n for k, n in have.items() if not test_quality_rules.brute(k)[-1]})
    if stage == "exact":  # per text the largest id; of rows alike in both one
        best = {}
        for i, t in have:
            if i is not None:
                best[fold(t)] = max(best.get(fold(t), i), i)
        return Counter((i, t) for i, t in {(i, fold(t)) for i, t in have} if best.get(t) == i)
    raise KeyError(stage)


def got(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_quality_judges_each_row(spark):
    rows = odd_rows()
    assert got(stages(spark)["quality"](frame(spark, rows))) == wanted("quality", rows)


def test_exact_keeps_one_of_equal_rows(spark):
    rows = odd_rows()
    df = stages(spark)["exact"](frame(spark, rows))
    assert Counter((r.doc_id, fold(r.text)) for r in df.select("doc_id", "text").collect()) == wanted("exact", rows)


def test_near_keeps_one_of_linked_rows(spark):
    rows = odd_rows()
    keyed = [(n, t, None, None, 0) for n, (_, t, *_) in enumerate(rows)]  # a number for each row
    group = {x[0]: x[2] for x in test_jaccard_join.brute(keyed)}
    size = {x[0]: x[1] for x in test_jaccard_join.brute(keyed)}
    left = got(stages(spark)["near"](frame(spark, rows)))
    for g in set(group.values()):
        members = [rows[n] for n in group if group[n] == g]
        kept = sum(min(left[(r[0], r[1])], 1) for r in {m[:2]: m for m in members}.values())
        if size[g]:
            least = min(key(m) for m in members)
            stays = [m for m in members if left[(m[0], m[1])]]
            assert kept == 1 and left[(stays[0][0], stays[0][1])] == 1 and key(stays[0]) == least
    empty = Counter((r[0], r[1]) for n, r in enumerate(rows) if not size[n])
    assert {k: left[k] for k in empty} == dict(empty)  # without a word: linked with nothing, all stay


def test_a_near_copy_under_another_id_does_not_bring_rows_back(spark):
    rng = random.Random(3)
    long = prose(rng, 100).split()
    copy = lambda i: " ".join([*long[:i], f"x{i}", *long[i + 1 :]])
    other = prose(rng, 60)
    rows = [(1, copy(50), "en", "a", 0), (1, copy(20), "en", "a", 0), (0, copy(90), "en", "a", 0), (1, other, "en", "a", 0)]
    assert got(jaccard_join.kept_documents(frame(spark, rows))) == Counter([(0, copy(90)), (1, other)])


def test_mixing_takes_what_was_decided(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    decided = Counter()
    for r in mixing.mix(docs).collect():
        decided[r.doc_id, r.size] += r.copies
    left = Counter()
    for (i, t), n in got(stages(spark)["mixing"](docs)).items():
        left[i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))] += n
    assert left == +decided


@pytest.mark.parametrize("stage", ["quality", "exact", "near", "mixing"])
def test_clashing_names(spark, stage):
    rows = [(i, t, lang, source, n) for i, t, lang, source, n in odd_rows()]
    plain = frame(spark, rows)
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    docs = plain.select("*", *[F.concat_ws("/", F.lit(c), F.col("doc_id")).alias(c) for c in NAMES])
    out = stages(spark)[stage](docs)
    assert out.columns == docs.columns
    assert got(out) == got(stages(spark)[stage](plain))
    same = [F.col(quoted(c)) == F.concat_ws("/", F.lit(c), F.col("doc_id")) for c in NAMES]
    assert out.filter(~F.array_min(F.array(*same))).count() == 0


@pytest.mark.parametrize("stage", ["quality", "exact", "near", "mixing"])
def test_empty_tables_and_null_columns(spark, stage):
    assert stages(spark)[stage](frame(spark, [])).collect() == []
    nothing = [(None, None, None, None, None)] * 3
    assert len(stages(spark)[stage](frame(spark, nothing)).collect()) in (0, 1, 3)


@pytest.mark.parametrize("stage", ["quality", "exact", "near", "mixing"])
def test_a_stage_leaves_one_narrow_table(spark, stage):
    folder = shared.ensure_checkpoint_dir(spark).replace("file:", "")
    before = set(os.listdir(folder))
    docs = frame(spark, odd_rows())
    out = stages(spark)[stage](docs)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).split("-")[1] == "decided"
    out.count()


def test_scopes(spark):
    one = lambda outlives=False: shared.keep(spark.range(3), "scope-test", outlives)
    there = lambda df: os.path.exists(df.kept_at.replace("file:", ""))
    free = one()
    with shared.scratch(spark):
        outer = one()
        with shared.scratch(spark):
            inner, risen = one(), one(True)
        assert (there(inner), there(risen), there(outer)) == (False, True, True)
        gone = one()
        shared.release(gone)
        assert not there(gone)
        last = one(True)
    assert (there(risen), there(outer), there(last), there(free)) == (False, False, True, True)
    with pytest.raises(KeyError), shared.scratch(spark):
        lost = one()
        raise KeyError
    assert not there(lost)
