import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from fumble.llm import quality_rules as Q
from tests.llm.helpers import corpus, data, frame, prose, with_clashes

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
LABELS = "doc_id long, quality int, toxic int"


def brute(row):
    t = row[1] or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(8)}
    return (row[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


def texts():
    rng = random.Random(5)
    rows = corpus()
    for i in range(200, 260):  # overlapping repeats, lines and marks
        words = [rng.choice("abcd") for _ in range(rng.randrange(60))]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "  ", "\t", "# ", "|"]) for w in words), "de", "a", 0))
    rows += [(300, "x " * 500, "de", "a", 0), (301, "\n\na\n\na\n a\nb", "de", "a", 0), (302, "é𝒳 & <b> \u00a0 \x1c", "de", "a", 0)]
    return rows


def test_base_columns_equal_brute_force(spark):
    rows = texts()
    got = Q.quality_rules(with_clashes(frame(spark, rows)), spark.createDataFrame([], LABELS))
    assert data(got, *BASE) == sorted(map(brute, rows), key=repr)
    assert all(r.kept == (not r.base_failed) for r in got.collect())  # no labels, no method verdict


def tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_exact_binomial_bound(spark):
    cases = [(1, 0), (10, 0), (16, 1), (17, 2), (40, 3), (200, 5), (900, 1), (900, 20), (900, 45)]
    for p in (0.004, 0.05):
        df = spark.createDataFrame(cases, "n long, k long").withColumn("p", Q.binomial_tail(F.col("n"), F.col("k"), F.lit(p)))
        for r in df.collect():
            want = 1.0 if r.k > r.n * p else tail(r.n, r.k, p)
            assert math.isclose(r.p, want, rel_tol=1e-9), (r, want)
    big = spark.createDataFrame([(10**7, 39_000), (10**7, 0)], "n long, k long").select(Q.binomial_tail(F.col("n"), F.col("k"), F.lit(0.004))).collect()
    assert 0 < big[0][0] < 1e-6 and big[1][0] == 0.0


def planted(n_good, n_bad, bad_marks=3):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n_good + n_bad):
        mark = "" if i < n_good else "#" * bad_marks
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}{mark}" for _ in range(25)), "en" if i % 2 else "fr", "a", 0))
        labels.append((i, int(i < n_good), 0))
    return rows, labels


def test_cutoffs_reject_bad_documents_and_keep_good_ones(spark):
    rows, labels = planted(3000, 300)
    got = Q.quality_rules(frame(spark, rows), spark.createDataFrame(labels + labels[:5] + [(10**6, 0, 0), (7, None, 0)], LABELS))
    assert {r.doc_id for r in got.filter("not kept").collect()} == set(range(3000, 3300))


def test_few_labels_certify_nothing(spark):
    """With 40 good documents in all, no false rejection rate of two per cent can be ruled out."""
    rows, labels = planted(40, 20)
    assert Q.quality_rules(frame(spark, rows), spark.createDataFrame(labels, LABELS)).filter("not kept").count() == 0


def test_risk_is_controlled_where_a_metric_does_not_separate(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(4000):  # good and bad documents carry marks alike
        marks = rng.choice([0, 0, 0, 1, 2, 4])
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" + "#" * marks for _ in range(25)), "en", "a", 0))
        labels.append((i, rng.randrange(2), 0))
    got = Q.quality_rules(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    good = {i for i, q, _ in labels if q}
    lost = sum(r.doc_id in good for r in got.filter("not kept").collect())
    assert lost <= Q.RISK * len(good)


def rows_with_labels(seed, goods, bads):
    """Documents of several languages whose marks, lines and repeats differ with quality, but not wholly."""
    rng = random.Random(seed)
    rows, labels = [], []
    for lang in goods:
        for j in range(goods[lang] + bads[lang]):
            good = j < goods[lang]
            marks, lines = (rng.choice([0] * 30 + [1, 2]), 1) if good else (rng.choice([0, 1, 2, 4]), rng.choice([1, 4, 8]))
            words_ = [f"w{rng.randrange(10**6)}" + "#|"[j % 2] * marks for _ in range(24)]
            text = ("\n" if lines > 1 else " ").join([" ".join(words_), *["a repeated line"] * (lines - 1)])
            rows.append((len(rows), text, lang, "a", 0))
            labels.append((len(labels), int(good), 0))
    rows += [(len(rows) + i, "## " * 30 if i % 2 else prose(rng, 30), lang, "a", 0) for i, lang in enumerate(["new", None, "en", "de"])]  # not labelled
    return rows, labels


def metric(name, row):
    _, n, chars, symbols, dup_lines, repeats, _ = brute(row)
    lines = len([x for x in row[1].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    marks = len(re.findall(r"[!|]", row[1]))
    top, under = {"symbols": (symbols, n), "marks": (marks, n), "repeats": (repeats, n), "dup_lines": (dup_lines, lines), "long_words": (chars, n)}[name]
    return None if not under else 1000 * top // under


def verdicts(rows, labels, risk=Q.RISK, alpha=Q.ALPHA):
    """doc_id -> (kept, rejected_by), from the rules in the module's text."""
    steps = Q.sequence()
    hits = {}
    for r in rows:
        values = {name: metric(name, r) for name in Q.RULES}
        hits[r[0]] = [values[name] is not None and values[name] > Q.RULES[name][1][i] for name, i in steps]
    held = [(r[2], good, next((s for s, hit in enumerate(hits[r[0]]) if hit), None)) for r in rows if not brute(r)[-1] for i, good, _ in labels if i == r[0]]
    strata = {lang for lang, _, _ in held}

    def certified(some):
        n, best = sum(g for _, g, _ in some), None
        for s in range(len(steps)):
            k = sum(bool(g) and f is not None and f <= s for _, g, f in some)
            bad = sum(not g and f is not None and f <= s for _, g, f in some)
            if not n or k > n * risk or tail(n, k, risk) > alpha / len(strata):
                break
            if bad and (best is None or bad > best[0]):
                best = (bad, s)
        return None if best is None else best[1]

    pooled = certified(held) if held else None
    out = {}
    for r in rows:
        some = [x for x in held if x[0] == r[2]]
        own = sum(g for _, g, _ in some) * math.log(1 - risk) <= math.log(alpha / len(strata)) if some else False
        last = certified(some) if own else pooled
        by = [name for name in Q.RULES if last is not None and any(hit and n == name and s <= last for s, ((n, _), hit) in enumerate(zip(steps, hits[r[0]], strict=True)))]
        out[r[0]] = (not brute(r)[-1] and not by, ",".join(by))
    return out


def test_whole_method_against_brute_force(spark):
    kinds = set()
    for seed, goods in ((1, {"en": 400, "fr": 60, None: 50}), (2, {"en": 150, "fr": 60, "de": 40}), (3, {"en": 300, "fr": 300, "de": 250, "es": 20}), (4, {"en": 20, "fr": 5})):
        rows, labels = rows_with_labels(seed, goods, {lang: n // 4 for lang, n in goods.items()})
        got = {r.doc_id: (r.kept, r.rejected_by) for r in Q.quality_rules(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
        want = verdicts(rows, labels)
        assert got == want
        kinds.add((seed, any(by for _, by in want.values())))
    assert kinds == {(1, True), (2, True), (3, True), (4, False)}


def test_simulated_error_stays_below_alpha(spark):
    """Strata whose every step loses three per cent of the good documents, each a draw of its own."""
    rng = random.Random(6)
    n, strata, true = 400, 2000, 0.03
    counts = []
    for s in range(strata):
        k = sum(rng.random() < true for _ in range(n))
        counts += [(f"={s}", 0, k, 50), (f"={s}", None, n - k, 0)]
    df = spark.createDataFrame(counts, "stratum string, step int, good long, bad long")
    for alpha in (0.05, 0.2):
        wrong = Q.limits(df, ["stratum"], 1, Q.RISK, alpha).filter("last_step IS NOT NULL").count()
        assert wrong <= alpha * strata
    # at the risk itself the test errs about as often as it may
    assert Q.limits(df, ["stratum"], 1, true, 0.2).filter("last_step IS NOT NULL").count() <= 0.2 * strata + 60


def test_labels_that_a_step_needs(spark):
    """217 good documents suffice for one of four languages, 216 do not."""
    for n, found in ((216, 0), (217, 1)):
        counts = [("=en", 3, 0, 9), ("=en", None, n, 0)]
        got = Q.limits(spark.createDataFrame(counts, "stratum string, step int, good long, bad long"), ["stratum"], 4, Q.RISK, Q.ALPHA)
        assert got.filter("last_step = 3").count() == found


def test_empty_and_kept_documents(spark):
    none = spark.createDataFrame([], LABELS)
    assert Q.quality_rules(frame(spark, []), none).count() == 0
    rows = corpus()
    got = data(Q.kept_documents(frame(spark, rows), none), "doc_id")
    assert got == sorted([(r[0],) for r in rows if not brute(r)[-1]], key=repr)


def test_native(spark):
    df = Q.with_base_metrics(frame(spark, corpus()).select("doc_id", "text"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_of_one_id_stay_each_on_its_own(spark):
    """A row that stays does not bring back rejected rows of its id, or of no id."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(d, t, "en", "a", 0) for d in (1, None) for t in (good, "short", None)]
    got = Q.kept_documents(frame(spark, rows), spark.createDataFrame([], LABELS))
    assert data(got, "doc_id", "text") == sorted([(1, good), (None, good)], key=repr)
