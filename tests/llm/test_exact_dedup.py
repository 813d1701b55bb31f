import hashlib
from collections import Counter

import pandas as pd

from fumble.llm import exact_dedup as X
from tests.llm.helpers import corpus, data, frame, with_clashes

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(lowered(r[1]), []).append(r[0])
    out = []
    for r in rows:
        ids = groups[lowered(r[1])]
        best = max((i for i in ids if i is not None), default=None)
        out.append((r[0], best, len(ids), r[0] == best, hashlib.sha256(lowered(r[1]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_brute_force_with_and_without_heavy_groups(spark):
    rows = corpus()
    for counters in (1, 4, 1024):
        got = X.exact_dedup(with_clashes(frame(spark, rows)), counters=counters)
        assert data(got, *COLUMNS) == brute(rows)


def test_empty_table_and_lower_casing_is_ascii_only(spark):
    assert X.exact_dedup(frame(spark, [])).count() == 0
    rows = [(1, "É", "x", "y", 1), (2, "é", "x", "y", 1), (3, "E", "x", "y", 1), (4, "e", "x", "y", 1)]
    assert data(X.exact_dedup(frame(spark, rows)), *COLUMNS) == brute(rows)


def test_misra_gries_error_bound():
    stream = [b"a"] * 400 + [b"b"] * 250 + [b"%d" % i for i in range(350)]
    frames = [pd.DataFrame({"digest": stream[i::7]}) for i in range(7)]
    k = 9
    got = dict(zip(*(out := next(X.misra_gries(k)(iter(frames))))[["digest", "n"]].to_numpy().T, strict=True))
    assert len(out) <= k
    for d, n in Counter(stream).items():
        assert n - len(stream) / (k + 1) <= got.get(d, 0) <= n


def test_kept_documents_have_distinct_texts(spark):
    rows = [r for r in corpus() if r[0] is not None]
    got = X.kept_documents(frame(spark, rows)).distinct().collect()
    assert len({lowered(r.text) for r in got}) == len(got) == len({lowered(r[1]) for r in rows})


def test_rows_of_one_id_stay_each_on_its_own(spark):
    """A row that stays does not bring back duplicate rows of its id, or of no id."""
    rows = [(1, "A b", "en", "a", 0), (1, "own", "en", "a", 0), (2, "a B", "en", "a", 0), (None, "OWN", "en", "a", 0), (None, "lone", "en", "a", 0), (3, None, "en", "a", 0), (2, "", "en", "a", 0)]
    got = X.kept_documents(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(2, "a B"), (1, "own"), (None, "lone"), (3, None)], key=repr)
