"""Noise of one shared draw sequence against a plain loop."""

import random

import pytest

from conftest import SF01
from fumble.functions.noise import QWERTY_NEIGHBOURS
from fumble.functions import noise_compat as C
from fumble.plans.queries_corpus import q_compat_noise


def plain(text, variants=1, seed=0, most=10):
    """Draws taken one by one, a choice below 100 for each key and one of its neighbours for each typo."""
    rng, out = random.Random(seed), []
    for _ in range(variants):
        made = ""
        for char in text:
            low = char.lower()
            new = rng.choice(QWERTY_NEIGHBOURS[low]) if low in QWERTY_NEIGHBOURS and rng.choice(range(100)) <= most else low
            made += new if char == low else new.upper()
        out.append(made)
    return out


@pytest.mark.parametrize(("seed", "most"), [(0, 10), (7, 0), (3, 99), (5, 55)])
def test_variants_and_odd_characters(seed, most):
    noise = C.Compat(seed, most, "qwerty")
    rng = random.Random(seed)
    texts = ["", "q", "   " * 300, "K İ ẞ ß ſ ŉ a", "\U0001f600 A" * 50, "Łódź, JEŻ\n\t"] + ["".join(rng.choice("abcXYZ ,.é") for _ in range(rng.randrange(400))) for _ in range(60)]
    for text in texts:
        assert noise.texts(text, 3) == plain(text, 3, seed, most)


def test_longer_texts_draw_more_words(monkeypatch):
    monkeypatch.setattr(C, "FIRST_WORDS", 16)
    noise = C.Compat(1, 10, "qwerty")
    for text in ("ab", "some text " * 30, "ab", "x" * 5000):
        assert noise.texts(text, 2) == plain(text, 2, 1)


def test_every_document(spark):
    """All whole documents, each equal to the plain loop."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.typos for r in q_compat_noise(spark, SF01).collect()}
    assert got == {i: None if t is None else plain(t)[0] for i, t in texts.items()}


def test_unknown_keyboard_and_nulls(spark):
    df = spark.createDataFrame([("Some text",), (None,)], "t string")
    got = [r.x for r in df.select(C.keyboard_noise_compat("t", keyboard="none", variants=2).alias("x")).collect()]
    assert got == [["Some text", "Some text"], None]
    assert [r.x for r in df.select(C.keyboard_noise_compat("t", variants=2).alias("x")).collect()] == [plain("Some text", 2), None]
