"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets a rate in (0, 3]: the rates closest to 1 in relative
entropy whose words meet the source's target, which are
``min(3, exp(lambda * size / mean size))`` with one ``lambda`` per source. The
dual is convex; safeguarded Newton steps on it run as Spark jobs over the
counts by (source, size), which hold all that the equations need. Rates are
rounded into whole copies along a running sum of the rates in order of size,
so that rounding errors cancel within a source; of ``SHIFTS`` fixed offsets of
that sum each source takes the one that ends nearest its target. What then
still lacks or is over, some part of a long document, is met by single copies of
the size that fits best, at most ``ROUNDS`` for each source.

Running sums are three-level (size, bucket, document): no window holds more
than the sizes of a source, the buckets of one size, or about ``BUCKET`` rows.
Rates are whole multiples of 2^-30, so sums are exact and reruns agree.

Defined results: a null or empty text has size 0 and is taken 0 words; a null
source is a source of its own and comes last; a source without words has
target 0; rows that repeat a doc_id are mixed each on its own; an empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fumble.llm.shared import id_key, keep, n_words, scratch, taken

WEIGHTS = (5, 2, 1)
CAP = 3
ONE = 1 << 30
SHIFTS = 16
BUCKET = 65536
SALTS = 64
STEPS, TOLERANCE = 60, 1e-10
ROUNDS = 4  # single copies moved for each source
MOVED = "array<struct<at: long, size: long, step: long>>"


def _read(id_col: str, text_col: str, source_col: str) -> tuple[Column, Column, Column]:
    source = F.col(source_col).cast("string")
    key = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
    return F.col(id_col).alias("doc_id"), key.alias("source"), n_words(F.col(text_col).cast("string")).alias("size")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source key, size); the key sorts by code point, null last."""
    return docs.select(*_read(id_col, text_col, source_col))


def targets(by_source: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Resharing the excess by weight ends where every target is
    ``min(cap * size, level * weight)`` for one level; in order of size per
    weight the capped sources come first, which gives the level at once. The
    window holds one row per source."""
    order = Window.orderBy("source")
    w = F.element_at(F.array(*[F.lit(x).cast("double") for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = by_source.withColumn("weight", w).withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
    df = df.withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    below = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("rest", F.sum(F.col("source_size")).over(everything) - F.coalesce(F.sum("most").over(below), F.lit(0.0)))
    df = df.withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    df = df.withColumn("level", F.col("rest") / F.col("rest_weight"))
    # the first source whose own ratio reaches the level that is left when all before it are capped
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source", "level"))).over(everything)["level"]
    df = df.withColumn("final", level)
    return df.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"))


def solve(cells: DataFrame, goals: DataFrame, cap: int = CAP, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, lam): Newton on the dual of every source, kept inside a bracket.

    ``cells``: (source, size, n); ``goals``: (source, source_size, target).
    A source whose target is its cap needs no finite solution: lam is null."""
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    free = (F.col("source_size") > 0) & (F.col("target") < F.lit(cap) * F.col("source_size") * (1 - 1e-12))
    state = goals.filter(free).join(mean, "source").select("source", "target", "mean", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))
    state = keep(state, "mix-newton")
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
        got = cells.join(state.filter("not done"), "source").groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"),
            F.sum(F.when(rate < cap, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("slope"),
        )
        s = state.join(got, "source", "left")
        gap = F.col("words") - F.col("target")
        s = s.withColumn("near", F.col("done") | (F.abs(gap) <= F.lit(tolerance) * F.col("target")))
        s = s.withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
        # step out by doubling while one side is open, else halve when Newton leaves the bracket
        open_low = F.when(F.col("hi").isNull(), F.greatest(F.col("lam") * 2, F.lit(1.0)))
        middle = F.when(F.col("lo").isNull(), F.least(F.col("hi") * 2, F.lit(-1.0))).otherwise(F.coalesce(open_low, (F.col("lo") + F.col("hi")) / 2))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        inside = (newton > F.coalesce("lo", F.lit(-1e9))) & (newton < F.coalesce("hi", F.lit(1e9))) & (F.abs(newton - F.col("lam")) <= 4 + F.abs(F.col("lam")))
        lam = F.when(F.col("near"), F.col("lam")).otherwise(F.coalesce(F.when(inside, newton), middle))
        state = keep(s.select("source", "target", "mean", lam.alias("lam"), "lo", "hi", F.col("near").alias("done")), "mix-newton")
        if state.filter("not done").isEmpty():
            break
    return state.select("source", "mean", "lam")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    return _mixed(docs, id_col, text_col, source_col, weights, cap, bucket).drop("source")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, cap: int = CAP, bucket: int = BUCKET) -> DataFrame:
    narrow = keep(sized(docs, id_col, text_col, source_col), "mix-sizes")
    cells = keep(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    by_source = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = keep(targets(by_source, weights, cap), "mix-targets")
    lam = solve(cells, goals, cap)
    x = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
    rate = F.when(F.col("target") > 0, F.coalesce(F.least(F.lit(float(cap)), x), F.lit(float(cap)))).otherwise(0.0)
    rated = cells.join(goals, "source").join(lam, "source", "left").withColumn("rate", F.round(rate * ONE).cast("long"))
    rated = rated.withColumn("buckets", F.ceil(F.col("n") / F.lit(bucket)).cast("long"))
    # level 1: running sum of whole cells, in order of size within a source
    before = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rated = keep(rated.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0))).select("source", "size", "n", "rate", "buckets", "start", "source_size", "target"), "mix-rates")
    # level 2: buckets of the cells that have more than one
    df = narrow.join(rated, ["source", "size"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    split = df.filter("buckets > 1").groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    prior = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(prior), F.lit(0))).drop("in_bucket")
    df = df.join(split, ["source", "size", "bucket"], "left")
    # level 3: documents of one bucket
    rank = Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id")
    at = F.col("start") + (F.coalesce("ahead", F.lit(0)) + F.row_number().over(rank) - 1) * F.col("rate")
    df = keep(df.withColumn("at", at).select("doc_id", "source", "size", "source_size", "target", "rate", "at"), "mix-positions")
    copies = lambda shift: (F.floor((F.col("at") + F.col("rate") + shift) / F.lit(ONE)) - F.floor((F.col("at") + shift) / F.lit(ONE))).cast("long")
    shifts = [int(ONE * (2 * i + 1) / (2 * SHIFTS)) for i in range(SHIFTS)]
    sums = df.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(copies(F.lit(s)) * F.col("size")).alias(f"w{i}") for i, s in enumerate(shifts)])
    near = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{i}") - F.col("target")).alias("gap"), F.lit(s).cast("long").alias("shift"), F.col(f"w{i}").alias("words")) for i, s in enumerate(shifts)]))
    none = F.array().cast(MOVED)
    state = keep(sums.select("source", near["shift"].alias("shift"), (F.col("target") - near["words"]).alias("gap"), none.alias("moved")), "mix-shifts")
    df = df.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))

    def with_copies(state: DataFrame) -> DataFrame:
        """A source may hold a third of all rows: its rows are parted by a salt, its one row goes to every part."""
        salted = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = F.filter("moved", lambda m: (m["at"] == F.col("at")) & (m["size"] == F.col("size")) & (F.col("rate") > 0))
        step = F.aggregate(mine, F.lit(0).cast("long"), lambda t, m: t + m["step"])
        return df.join(salted, ["source", "salt"]).withColumn("copies", copies(F.col("shift")) + step)

    # what rounding leaves of a source's target: single copies of fitting size, one a round, are taken or left out
    for _ in range(ROUNDS):
        step, lack = F.signum("gap").cast("long"), F.abs("gap")
        fits = (F.col("rate") > 0) & (F.col("size") > 0) & (F.col("size") < 2 * lack) & (F.col("copies") + step).between(0, cap)
        best = with_copies(state).filter(fits).groupBy("source").agg(F.min(F.struct(F.abs(lack - F.col("size")).alias("rest"), "at", "size")).alias("best"))
        moved = F.when(F.col("best").isNotNull(), F.concat("moved", F.array(F.struct(F.col("best.at").alias("at"), F.col("best.size").alias("size"), step.alias("step"))))).otherwise(F.col("moved"))
        gap = F.col("gap") - F.coalesce(step * F.col("best.size"), F.lit(0))
        state = keep(state.join(best, "source", "left").select("source", "shift", gap.alias("gap"), moved.alias("moved")), "mix-shifts")
    return with_copies(state).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents with all their columns, each row as often as the mix takes
    it. Rows alike in doc_id, source and size, for which the mix has no order,
    share their copies: each the whole part, and the first rows one more."""
    with scratch(docs.sparkSession):
        mixed = _mixed(docs, id_col, text_col, source_col, **options)
        shares = mixed.groupBy(id_key(F.col("doc_id")).alias("id"), "source", "size").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
        decided = keep(shares, "mix-decided", outlives=True)
    doc, source, size = _read(id_col, text_col, source_col)
    return taken(docs, [id_key(doc), source, size], decided)
