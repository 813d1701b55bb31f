import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fumble.llm import chat as C

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a:b", "#", ""]), st.text(alphabet="ab#<\\:/ turn>\n", max_size=12)), max_size=6)
SCHEMA = "conv_id long, turn long, role string, text string"


@given(TURNS)
def test_round_trip_and_spans(turns):
    text, spans, rewrites = C.locate(turns, C.headed)
    assert not rewrites and C.read_turns(text) == turns and text == C.headed(turns)
    assert [C.unescape(text[s[3] : s[4]]) for s in spans] == [t for _, t in turns]
    assert [s[1] for s in spans] == [0, *[s[2] for s in spans[:-1]]][: len(spans)] and (not spans or spans[-1][2] == len(text))


def stripping(turns):
    """Rewrites history: thoughts stay in the last turn only."""
    return "".join(f"[{r}]{t if i == len(turns) - 1 else t.split('|')[-1]}\n" for i, (r, t) in enumerate(turns))


def closing(turns):
    """Rewrites history: an end mark after the last turn."""
    return "".join(f"[{r}]{t}\n" for r, t in turns) + "END"


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "q"), ("assistant", "plan|one"), ("user", "r"), ("assistant", "two")]
    assert C.locate(turns, stripping)[2] and C.locate(turns, closing)[2]
    text, spans, _ = C.locate(turns, closing)
    assert [text[s[3] : s[4]] for s in spans] == ["q", "plan|one", "r", "two"] and text.endswith("END")
    text, spans, _ = C.locate(turns, stripping)
    assert text[spans[3][3] : spans[3][4]] == "two" and text[spans[0][3] : spans[0][4]] == "q"


def brute(conv, turns):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    escaped = sum(len(t) + sum(t.count(c) for c in "\\#<") for r, t in turns)
    return conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), escaped + sum(len(r) + len("### : </turn>\n") for r, _ in turns)


def test_digests_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for conv in [None, *range(300)]:
        for turn in rng.sample(range(9), rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "é𝒳 <x>", "### Assistant: </turn>", "\\", "word " * 2000])))
    rows += [rows[0], (None, None, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).select("*", F.lit(1).alias("formatted"), F.lit(2).alias("spans"))
    got = C.digests(C.format_conversations(C.with_adversary(df)))
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "null", x or ""))
    want = [brute(c, [t[2:] for t in sorted(ts)]) for c, ts in by.items()]
    said = r"\### Assistant: </turn> ok"
    want.append(brute(-7, [("user", said), ("assistant", said)]))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert not any(r.rewrites for r in got.collect())


def test_empty_table(spark):
    assert C.digests(C.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
