"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base rules are fixed. The method's rules reject a document whose metric is
above a cutoff; cutoffs come from labelled good documents. All rules share one
fixed sequence of steps, each of which tightens the cutoff of one rule by a
notch: first every rule's mildest cutoff, then the next ones. A step rejects
what any rule rejects by then, so its rejections contain those of the steps
before, and a document's metrics give the first step that rejects it.

For every stratum (language) and step the exact binomial test asks whether a
false rejection rate above ``risk``, of all rules together, is ruled out: with k
of n good documents rejected, P(Bin(n, risk) <= k) must not exceed ``alpha`` /
strata. As k only grows along the sequence, the steps before the first that
fails are those that pass (fixed-sequence testing; Bonferroni over strata only).
So with probability 1 - ``alpha`` no stratum with a sequence of its own loses
more than ``risk`` of its good documents. Of the certified steps the one that
rejects most labelled bad documents is used, the mildest of equals; without a
bad document rejected, none.

A stratum with too few good documents to certify any step, ln(alpha / strata) /
ln(1 - risk), takes the step certified on the good documents of all strata
together. Its guarantee is weaker: of all good documents together no more than
``risk`` are lost by that step, in one such stratum it may be more. These tests
are no more than the strata, so ``alpha`` holds for all of them. Whether a
stratum is tested on its own rests on its count of labels alone.

Defined results: a null or empty text has no words and fails the base rule;
a null stratum is a stratum of its own; labels without a document, or null
labels, are ignored; a document labelled twice counts with its worst label;
rows that repeat a doc_id are judged each on its own; empty tables give no
rows (documents) or no method verdict (labels). Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fumble.llm.shared import SPACE, id_key, keep, scratch, taken, text_digest, words

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
WINDOW = 8
RISK, ALPHA = 0.02, 0.05
# rule -> (metric in SQL over the base columns, cutoffs from mild to strict); metrics are per mille.
RULES = {
    "symbols": ("1000 * n_symbols / nullif(n_words, 0)", [2000, 1500, 1000, 750, 500, 300, 200, 100, 50]),
    "marks": ("1000 * n_marks / nullif(n_words, 0)", [1000, 900, 800, 700, 600, 500, 400, 300, 200, 100]),
    "repeats": ("1000 * n_repeat_words / nullif(n_words, 0)", [290, 250, 200, 150, 100, 50]),
    "dup_lines": ("1000 * n_dup_lines / nullif(n_lines, 0)", [800, 700, 600, 500, 400, 300, 200]),
    "long_words": ("1000 * word_chars / nullif(n_words, 0)", [20000, 18000, 16000, 14000, 12000]),
}


def shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def window_hashes(ws: Column, width: int = WINDOW) -> Column:
    """One 64-bit hash for each window of ``width`` words; none for fewer words."""
    starts = F.sequence(F.lit(1), F.size(ws) - (width - 1))
    return F.when(F.size(ws) >= width, F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, width)))).otherwise(F.array().cast("array<bigint>"))


def with_base_metrics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marks.

    Repeats: windows are sorted by (hash, position); a window equal to its
    neighbour is repeated, and the words covered by repeated windows are
    counted from the gaps of their sorted positions. The sort runs only for
    texts with a repeated window."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in df.columns if c != text_col]
    df = df.select(
        *kept,
        words(F.col(text_col)).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[!|]+", ""))).cast("long").alias("n_marks"),
    )
    df = df.withColumn("_hashes", window_hashes(F.col("_words")))
    df = df.withColumn("_distinct", F.size(F.array_distinct("_hashes")))
    pairs = F.arrays_zip(F.col("_hashes").alias("h"), F.sequence(F.lit(1), F.size("_hashes")).alias("i"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_sorted", F.when(F.col("_distinct") < F.size("_hashes"), F.array_sort(pairs)).otherwise(none))
    same = F.zip_with("_sorted", shifted(F.col("_sorted"), 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    df = df.withColumn("_next", same)
    before = F.concat(F.array(F.lit(False)), F.col("_next"))
    hit = F.zip_with("_sorted", F.zip_with("_next", before, lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))), lambda s, f: F.when(f, s["i"]))
    df = df.withColumn("_at", F.when(F.size("_sorted") > 0, F.array_sort(F.array_compact(hit))).otherwise(F.array().cast("array<int>")))
    gaps = F.zip_with("_at", shifted(F.col("_at"), 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return df.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g).alias("n_repeat_words"),
        "n_marks",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def ln_factorial(n: Column) -> Column:
    """ln(n!): a product up to 16, Stirling's series with four terms beyond (error below 1e-12)."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(16)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(F.greatest(i, F.lit(1)).cast("double")))
    y = x + 1.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return F.when(n <= 16, small).otherwise((y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series)


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k) for k <= n p, else 1: the mode's other side never certifies.

    Terms fall from i = k downwards; 12 sqrt(n) + 64 of them hold all but a
    1e-60 part of the sum."""
    top = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * F.log(p) + (n - k) * F.log(1 - p)
    steps = F.least(k, F.ceil(F.lit(12) * F.sqrt(n.cast("double"))) + 64).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(s: Column, j: Column) -> Column:
        i = k - j + 1  # the term of i - 1 over the term of i
        term = s["term"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, down, lambda s: s["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def sequence(rules=RULES) -> list[tuple[str, int]]:
    """The steps: (rule, notch), all mildest cutoffs first."""
    return [(name, i) for i in range(max(len(cuts) for _, cuts in rules.values())) for name, (_, cuts) in rules.items() if i < len(cuts)]


def rule_steps(rules=RULES) -> dict[str, Column]:
    """For each rule the step from which on it rejects a document, null if none
    does. Metrics are per mille, rounded down; a metric over nothing is null."""
    place = {step: i for i, step in enumerate(sequence(rules))}
    out = {}
    for name, (sql, cuts) in rules.items():
        metric = F.floor(F.expr(sql)).cast("long")
        passed = F.size(F.filter(F.array(*[F.lit(int(c)).cast("long") for c in cuts]), lambda c: c >= metric))  # noqa: B023
        at = F.get(F.array(*[F.lit(place[name, i]) for i in range(len(cuts))]), passed)
        out[name] = F.when(metric.isNotNull(), at)
    return out


def first_step(rules=RULES) -> Column:
    return F.least(*rule_steps(rules).values(), F.lit(None).cast("int"))


def limits(counts: DataFrame, by: list[str], tests: int, risk: float, alpha: float) -> DataFrame:
    """(*by, n_good, last_step): the certified step of each group of ``counts``
    (*by, step, good, bad), null where none is; a group has a row for each step at most."""
    order = Window.partitionBy(*by).orderBy(F.col("step").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*by)
    rows = counts.select(*by, "step", F.sum("good").over(every).alias("n"), F.sum("good").over(upto).alias("n_false"), F.sum("bad").over(upto).alias("n_bad"))
    ok = F.col("step").isNotNull() & (F.col("n") > 0) & (F.col("n_bad") > 0) & (binomial_tail(F.col("n"), F.col("n_false"), F.lit(risk)) <= alpha / max(1, tests))
    best = F.min(F.when(ok, F.struct((-F.col("n_bad")).alias("less"), "step")))
    return rows.groupBy(*by).agg(F.max("n").alias("n_good"), best["step"].alias("last_step"))


def thresholds(metrics: DataFrame, labels: DataFrame, rules=RULES, risk: float = RISK, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """((stratum, n_good, last_step) of the strata that are tested on their own,
    one row (n_good, last_step) for all other strata).

    ``metrics``: doc_id, stratum and the base columns; ``labels``: doc_id, quality."""
    marks = labels.filter("quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    held = metrics.filter(~base_failed()).join(marks, "doc_id").select("stratum", "good", first_step(rules).alias("step"))
    counts = keep(held.groupBy("stratum", "step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "quality-counts")
    tests = counts.select("stratum").distinct().count()
    own = limits(counts, ["stratum"], tests, risk, alpha).filter(F.col("n_good") * F.log(F.lit(1 - risk)) <= F.log(F.lit(alpha / max(1, tests))))
    pooled = counts.groupBy("step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return own, limits(pooled, [], tests, risk, alpha)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", rules=RULES, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, the base columns, base_failed, kept, and the rules that reject it."""
    out = _judged(docs.select(*_read(id_col, text_col, stratum_col)), labels, rules, risk, alpha)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", _kept(),
        F.array_join("rejected_by", ",").alias("rejected_by"),
    )


def _read(id_col: str, text_col: str, stratum_col: str) -> tuple[Column, Column, Column]:
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null"))
    return F.col(id_col).alias("doc_id"), stratum.alias("stratum"), F.col(text_col).cast("string").alias("text")


def _kept() -> Column:
    return (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept")


def _judged(df: DataFrame, labels: DataFrame, rules, risk: float, alpha: float) -> DataFrame:
    """Adds the base columns, base_failed and rejected_by to rows of doc_id, stratum and text; other columns stay."""
    metrics = keep(with_base_metrics(df), "quality-metrics")
    own, pooled = thresholds(metrics, labels, rules, risk, alpha)
    own, pooled = keep(own, "quality-limits"), pooled.agg(F.max("last_step").alias("s")).scalar()
    judged = metrics.join(own.select("stratum", "last_step", F.lit(True).alias("alone")), "stratum", "left")
    last = F.when(F.col("alone"), F.col("last_step")).otherwise(pooled)
    rejects = [F.when(step <= last, F.lit(name)) for name, step in rule_steps(rules).items()]
    return judged.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_compact(F.array(*rejects)))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", rules=RULES, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """The documents that stay, with all their columns. A row is met again by its
    doc_id, stratum and text, all that its verdict rests on."""
    doc, stratum, text = _read(id_col, text_col, stratum_col)
    with scratch(docs.sparkSession):
        judged = _judged(docs.select(doc, stratum, text, text_digest(text_col).alias("digest")), labels, rules, risk, alpha)
        rows = judged.groupBy(id_key(F.col("doc_id")).alias("id"), "stratum", "digest").agg(F.count(F.lit(1)).alias("rows"), F.count_if(_kept()).alias("copies"))
        decided = keep(rows, "quality-decided", outlives=True)
    return taken(docs, [id_key(doc), stratum, text_digest(text_col)], decided)
