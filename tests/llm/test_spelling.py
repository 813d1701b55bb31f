import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fumble.llm import spelling as S
from fumble.llm.queries import op12_spelling_variants
from tests.conftest import SF001
from tests.llm.helpers import corpus, data, frame, with_clashes

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(w, alphabet):
    for i in range(len(w) + 1):
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            yield from (w[:i] + c + w[i + 1 :] for c in alphabet if c != w[i])
        yield from (w[:i] + c + w[i:] for c in alphabet)


def judged(counts):
    """Rows from the counts of all words."""
    known = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    alphabet, form, near = sorted({c for w in known for c in w}), {}, {}
    for w, n in known.items():
        near[w] = {x for x in edits(w, alphabet) if x in known}
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        form[w] = best if best is not None and known[best] >= 5 * n else None
    rows = []
    for w, n in known.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), known.get(form[w])))
    return sorted(rows, key=repr)


def counted(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def variants(seed, n, heads=("",)):
    """Words with counts: edits of edits, so that forms make chains."""
    rng = random.Random(seed)
    words = [rng.choice(heads) + "".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 12))) for _ in range(n)]
    for _ in range(2 * n):
        words.append(rng.choice(list(edits(rng.choice(words), "abcé"))))
    return {w: rng.choice([5, 6, 25, 30, 150, 800, 4000]) for w in words}


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_all_words_one_edit_apart(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {"a" * 3000, "a" * 2999})
    index = S.PositionIndex(words)
    for q in rng.sample(words, 60) + ["zzz", "abz", "a" * 3001]:
        letters = np.array([[ord(c) for c in q]], np.uint32)
        got = {words[j] for j in index.one_edit(letters)[1]}
        assert got == set(edits(q, "abéz")) & set(words) - {q}


@pytest.mark.parametrize(("block", "heads"), [(S.BLOCK, ("",)), (16, ("",)), (16, ("aaaaaa", "abcabc")), (40, ("aaaaaa",))])
def test_forms_and_roots(spark, block, heads):
    counts = variants(len(heads) + block, 150, heads)
    known = S.keep(spark.createDataFrame([(w, n) for w, n in counts.items() if len(w) >= 6], "word string, n long"), "spelling-test")
    got = {r.word: (r.n_near, r.near_n, r.near) for r in S.near_counts(known, block).collect()}
    for w, form, _, n, n_near, form_n in judged(counts):
        assert got.get(w, (0,))[0] == n_near
        if form is not None:
            assert got[w][1:] == (form_n, form)


def test_chains_end_in_their_root(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("x", "w5"), ("y", "z")]
    got = dict(tuple(r) for r in S.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert got == {w: "z" if w == "y" else "w20" for w, _ in forms}


def test_odd_rows_and_names(spark):
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in corpus()]
    for w, n in variants(9, 40).items():
        rows.append((1000 + len(rows), " ".join([w, w.upper(), "x"] * (n // 20 + 2)) + "×÷ d’"))
    rows += [(None, "letters letters"), (5000, "longest" * 900 + " "), (5001, ("ab" * 300 + " ") * 5), (5002, ("ab" * 300 + "a ") * 40), rows[-1]]
    rng.shuffle(rows)
    df = with_clashes(frame(spark, [(d, t, "en", "a", 0) for d, t in rows])).selectExpr("*", "1 AS n", "2 AS form", "3 AS run", "4 AS name", "5 AS parts", "6 AS key")
    assert data(S.spelling_variants(df), *COLUMNS) == judged(counted(rows))


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    assert data(op12_spelling_variants(spark, SF001), *COLUMNS) == judged(counted(rows))


def test_empty_table(spark):
    assert data(S.spelling_variants(frame(spark, [])), *COLUMNS) == []
