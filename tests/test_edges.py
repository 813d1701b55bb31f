"""Edge tables: empty, null, one word, unclosed tags, duplicates, CSV dialect."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fumble.functions import tags as TG
from fumble.functions.noise import keyboard_noise, noise_text
from fumble.functions.text import norm_key, py_strip, word_count, words_joined
from fumble.operators import corrupt, render, report, sample, score
from fumble.sources import files


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("x")).first()["x"]


def test_strip_and_words_are_unicode_aware(spark):
    s = "　\t a   b\n\x1c"
    assert one(spark, py_strip(F.col("s")), s) == s.strip()
    assert one(spark, words_joined(F.col("s")), s) == " ".join(s.split())
    assert one(spark, word_count(F.col("s")), s) == 2
    assert one(spark, norm_key(F.col("s")), None) == ""


@pytest.mark.parametrize("text,want", [
    ("", ""), ("one", ""), ("one two", ""), ("a b c d", "b c"), (" a b ", "a b"), ("a  b", " "[:0] + ""),
])
def test_trim_edge_words(spark, text, want):
    want = " ".join(text.split(" ")[1:-1])
    assert one(spark, corrupt.trim_edge_words(F.col("s")), text) == want


def test_crop_keeps_short_text_whole(spark):
    df = spark.createDataFrame([(1, "short text"), (2, "x" * 2500)], "doc_id long, text string")
    out = {r.doc_id: r.p for r in df.select("doc_id", corrupt.crop_passage("text", F.col("doc_id"), F.lit(0)).alias("p")).collect()}
    assert out[1] == "short text" and len(out[2]) == 1000


def test_noise_edge_texts(spark):
    rows = [(1, ""), (2, None), (3, "ẞ straße"), (4, "😀 emoji \\n literal"), (5, "İstanbul KELVIN")]
    df = spark.createDataFrame(rows, "k long, t string")
    for impl in ("native", "arrow"):
        out = {r.k: r.n for r in df.select("k", keyboard_noise(F.col("t"), F.col("k"), prob=0.5, impl=impl).alias("n")).collect()}
        assert out[1] == "" and out[2] is None
        assert out[3].startswith("SS")
        assert "😀" in out[4]
    unknown = df.select(keyboard_noise(F.col("t"), F.col("k"), keyboard="azerty").alias("n")).collect()
    assert [r.n for r in unknown] == [r[1] for r in rows]
    assert noise_text("abc", "x", 0) == noise_text("abc", "x", 0)


def test_sampling_with_small_groups(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(30)], "doc_id long, source string")
    out = sample.sample_per_source(df, k=20).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in out} == {"a": 3, "b": 20}
    rounds = sample.sample_rounds(df, rounds=3, k=2)
    assert rounds.count() == 12 and rounds.select("doc_id", "round").distinct().count() == 12


def test_tags_edge_cases(spark):
    cases = {
        "<think>a": (False, False, False),
        "<answer>x</answer><think>y</think>": (True, True, False),
        "</think><think>x</think>": (True, False, False),
        "<think></think><answer></answer>": (True, True, True),
        "": (False, False, False),
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: (r.has_think, r.has_answer, r.proper_format) for r in df.select("c", *TG.format_check(F.col("c"))).collect()}
    assert got == cases
    ans = one(spark, TG.extract_answer(F.col("s")), "wstęp Odpowiedź: a Odpowiedź:  b ")
    assert ans == "b"


def test_realign_duplicates_last_wins(spark):
    prompts = spark.createDataFrame([(0, "A b"), (1, "a  B"), (2, "c"), (3, None)], "idx long, prompt string")
    results = spark.createDataFrame([(0, "ab", "first"), (1, " A B ", "second"), (2, "zzz", "lost")],
                                    "ridx long, prompt string, completion string")
    got = {r.idx: r.completion for r in score.realign_completions(prompts, results).collect()}
    assert got == {0: None, 1: "second", 2: None, 3: None}


def test_backtick_and_prefix(spark):
    m = render.SFT_INSTRUCTION + "`abc`"
    assert one(spark, render.backtick_payload(F.col("s")), m) == "abc"
    assert one(spark, render.backtick_payload(F.col("s")), render.SFT_INSTRUCTION + "`abc") == ""
    assert one(spark, render.backtick_payload(F.col("s")), "plain `x`") == "plain `x`"
    df = spark.createDataFrame([("PROMPTgenerated  ", "PROMPT")], "g string, p string")
    assert df.select(render.strip_prefix(F.col("g"), F.col("p"))).first()[0] == "generated"


def test_evaluation_means_empty_default(spark):
    empty = spark.createDataFrame([], "exact_match int, char_accuracy double, word_accuracy double, cer double")
    r = report.evaluation_means(empty).first()
    assert (r.exact_match_rate, r.avg_char_accuracy, r.avg_word_accuracy, r.avg_cer, r.n_rows) == (0.0, 0.0, 0.0, 1.0, 0)


def test_csv_dialect_round_trip(spark):
    d = tempfile.mkdtemp(prefix="fumble-csv-")
    rows = [('a "q", b', "x\\n y"), ("", ""), (" lead ", "t "), ("NA", "ok")]
    files.write_pairs(spark.createDataFrame(rows, "correct string, typos string"), os.path.join(d, "p"), mode="overwrite")
    ok, bad = files.read_pairs(spark, os.path.join(d, "p"))
    got = sorted((r.correct, r.typos) for r in ok.collect())
    assert got == sorted([('a "q", b', "x\\n y"), ("", ""), ("lead", "t"), ("NA", "ok")])
    assert bad.count() == 0
    with open(os.path.join(d, "raw.csv"), "w") as f:
        f.write('"c\rd",\nNA,x\n')
    ok2, bad2 = files.read_pairs(spark, os.path.join(d, "raw.csv"))
    assert bad2.count() == 1 and [r.correct for r in bad2.collect()] == ["c\rd"] and ok2.count() == 1
    # a carriage return in a quoted field stays what it is
    files.write_pairs(spark.createDataFrame([("c\rd", "x\ry z")], "correct string, typos string"), os.path.join(d, "cr"), mode="overwrite")
    assert [tuple(r) for r in files.read_pairs(spark, os.path.join(d, "cr"))[0].collect()] == [("c\rd", "x\ry z")]
    nan_ok, _ = files.read_pairs(spark, os.path.join(d, "raw.csv"), null_as_nan=True)
    assert sorted((r.correct, r.typos) for r in nan_ok.collect())[-1] == ("nan", "x")


def test_swapped_column_order(spark):
    d = tempfile.mkdtemp(prefix="fumble-csv-")
    with open(os.path.join(d, "s.csv"), "w") as f:
        f.write("typo text,correct text\n")
    ok, _ = files.read_pairs(spark, os.path.join(d, "s.csv"), columns=files.SWAPPED_ORDER)
    r = ok.first()
    assert r.typos == "typo text" and r.correct == "correct text"


def test_comparison_display(spark):
    cmp = spark.createDataFrame([("r", 1, 0.5, 0.625, 0.125, 25.0)],
                                "run_id string, eval_idx int, baseline_cer double, current_cer double, "
                                "improvement_cer double, pct_change_cer double")
    for k in ("exact_match", "char_accuracy", "word_accuracy"):
        for pre in ("baseline", "current", "improvement", "pct_change"):
            cmp = cmp.withColumn(f"{pre}_{k}", F.lit(0.0))
    rows = {r.metric: r for r in report.comparison_display(cmp).collect()}
    r = rows["CER (lower=better)"]
    assert (r.baseline, r.current, r.improvement, r.pct_change) == ("50.00%", "62.50%", "+12.50pp", "+25.0%")


def test_one_turn_conversation_keeps_its_row(spark):
    conv = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b"), (2, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.rendered for r in render.render_conversations(conv, drop_last=True).collect()}
    marker = render.CHATML["generation"]
    assert got[1] == marker and got[2].endswith(marker) and "b" in got[2]


def test_distance_alphabet_covers_documents_and_layouts(spark):
    """The oracle's one-byte codes: a code for every non-ASCII character, and none that a text uses."""
    from conftest import SF01
    from fumble.plans import common, queries_reward
    from fumble.sources.tables import load

    chars = set()
    for r in load(spark, SF01, "documents").select("text").collect():  # a test table of 1,000 rows
        chars |= set(r.text or "")
    chars |= set(queries_reward.LAYOUT_THINK_TEXT + queries_reward.LAYOUT_BAD_THINK + queries_reward.LAYOUT_BAD_ANSWER)
    assert {c for c in chars if ord(c) > 127} <= set(common.NON_ASCII)
    assert len(common.ONE_BYTE) == len(common.NON_ASCII) == len(set(common.ONE_BYTE)) and not chars & set(common.ONE_BYTE)
    assert all(ord(c) < 128 for c in common.ONE_BYTE)


def test_message_list_completions(spark):
    """The first message's content; an empty or missing list gives ''."""
    from fumble.operators import reward

    rows = [(1, "text ", None), (2, None, [("assistant", " said "), ("user", "no")]), (3, None, []), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, completion string, messages array<struct<role:string,content:string>>")
    got = {r.id: r.completion for r in reward.completion_text(df, strip=True).collect()}
    assert got == {1: "text", 2: "said", 3: "", 4: ""}


def test_unmatched_completions_are_reported(spark):
    from fumble.operators import reward

    comps = spark.createDataFrame([(1, "a"), (1, "b"), (9, "c")], "doc_id long, completion string")
    pairs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, correct string")
    matched, unmatched = reward.join_completions(comps, pairs, ["doc_id"])
    assert matched.count() == 2 and [r.completion for r in unmatched.collect()] == ["c"]


def test_shared_folder_is_asked_for_on_a_cluster():
    import pytest
    from fumble.session import ensure_checkpoint_dir

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Cluster:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Cluster())
