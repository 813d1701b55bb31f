"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every whole text: good (1), bad (-1) or
nothing (0). Expectation-maximisation over the counts of vote patterns - at
most 3^labellers rows, however many documents - estimates the share of good
documents and each labeller's chance of each vote given the truth, without
any given label. The posterior of a pattern is the soft label of its
documents; a logistic regression on the presence of hashed words, word shapes,
stems that a text repeats and shares of odd or repeated words learns from the
soft labels of a sample and scores every document. The sample has the documents
with the least hash of each vote pattern: its share of ``SAMPLE``, and at least
an even share of another ``SAMPLE`` or up to ``LEAST`` of them, so that no
pattern is missed at any size; in the fit a document stands for as many as its
pattern has for each one drawn. Two tasks are learnt this way, well-formed text
and clean language; a document is kept if both scores are at least 0.5.

The labellers of language rest on two kinds of evidence. Some look for listed
words, which know one language only and attest nothing where they are missing.
The others look for crowded stems, in any language: a stem (the first ``STEM``
letters of a longer word) of which few documents have many different words
each. Under even use a stem on a share t of all distinct words of documents
would meet itself t^2 * sum(n * n) times within documents of n distinct words;
a stem is crowded if it does ``CROWD`` times as often, in ``CROWD_DOCS``
documents at least and with ``CROWD_WORDS`` different words near each other, so
that copies of one text crowd nothing. At most ``CROWDED`` stems are sent to the
tasks, those that meet themselves most.

Defined results: a null or empty text gets the labellers' votes for no words;
ties in score are kept; rows that repeat a doc_id are scored each on its own;
an empty table gives no rows; if nothing falls into the sample, a score is the
posterior. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumble.llm.shared import keep, with_package
from fumble.llm.tokens import slices
from fumble.llm.words import word_codes

SAMPLE = 6_000
LEAST = 64  # documents of a pattern that are drawn where it has them
BUCKETS = 1 << 18
FEATURE_ROWS = 16  # sampled documents that a feature needs for a weight
PART = 1 << 23  # bytes of text at a time
# The lexicon of the language labellers.
LEXICON = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
PLAIN = re.compile(r"[a0-9'’\-]+[.,;:]?")  # the shape of an ordinary word
# the same, and the run of capitals, in the words themselves
PLAIN_WORD, CAPITAL_RUN = r"^[\p{L}\p{Nl}\p{No}0-9'’\-]+[.,;:]?$", r"[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ]"
STEM, CROWD, CROWD_DOCS, CROWD_WORDS, CROWDED = 5, 24, 5, 8, 1 << 14
CAPITALS, LETTERS = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), re.compile(r"[^\W\d_]+")
NUMBERS = ("n", "n_odd", "kinds_odd", "n_again", "n_distinct", "n_toxic", "kinds_toxic")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def shape(word: str) -> str:
    """A word with its letters as ``a``, and capitals in a row as ``X``."""
    return LETTERS.sub("a", CAPITALS.sub("\x00", word)).replace("\x00", "X")


def _coded(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct strings, the code of each)."""
    coded = strings.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64)


def _buckets(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)).astype(np.int64) & (BUCKETS - 1)


def stem_key(stem: str) -> int:
    return xxhash.xxh3_64_intdigest(stem) >> 1


class Measures:
    """What the labellers look at in a part of the texts, and the texts' features.

    Everything about a word is worked out once for each distinct word."""

    def __init__(self, texts: pa.Array):
        words, codes, counts = word_codes(texts, lower=False)
        words, at = words.cast(pa.string()), len(texts)
        cores, core_of = _coded(pc.utf8_rtrim(pc.utf8_lower(words), ".,;:"))
        # shapes are written out for odd words only
        odd_words = np.asarray(pc.or_(pc.invert(pc.match_substring_regex(words, PLAIN_WORD)), pc.match_substring_regex(words, CAPITAL_RUN)).cast(pa.uint8())).astype(bool)
        shapes, shape_of = {"": 0}, np.zeros(len(words), np.int64)
        for i, w in zip(np.flatnonzero(odd_words).tolist(), words.filter(pa.array(odd_words)).to_pylist(), strict=True):
            shape_of[i] = shapes.setdefault(shape(w), len(shapes))
        long = pc.and_(pc.greater(pc.utf8_length(cores), STEM), pc.utf8_is_alpha(cores))
        stems, stem_of = _coded(pc.if_else(long, pc.utf8_slice_codeunits(cores, 0, STEM), ""))
        empty = stems.to_pylist().index("") if not np.asarray(long.cast(pa.uint8())).all() else -1
        text = np.repeat(np.arange(at), counts)
        core, odd = core_of[codes], shape_of[codes]
        toxic_core = np.asarray(pc.is_in(cores, pa.array(LEXICON)).cast(pa.uint8())).astype(bool)
        again = np.zeros(len(core), bool)
        again[1:] = (core[1:] == core[:-1]) & (text[1:] == text[:-1])
        wide, tall, deep = max(1, len(cores)), len(shapes), max(1, len(stems))
        has = np.unique(text * wide + core)
        has_odd = np.unique((text * tall + odd)[odd > 0])
        owner, has_core = has // wide, has % wide
        count = lambda rows: np.bincount(rows, minlength=at)
        toxic, toxic_kinds = (toxic_core[core], toxic_core[has_core]) if len(core) else (np.zeros(0, bool),) * 2
        values = counts, count(text[odd > 0]), count(has_odd // tall), count(text[again]), count(owner), count(text[toxic]), count(owner[toxic_kinds])
        self.numbers = dict(zip(NUMBERS, values, strict=True))
        # stems: how many distinct words of each a text has
        stem = stem_of[has_core] if len(has) else np.zeros(0, np.int64)
        pair, self.stem_words = np.unique((owner * deep + stem)[stem != empty], return_counts=True)
        self.stem_text, self.stem = pair // deep, pair % deep
        self.stem_keys = np.fromiter(map(stem_key, stems.to_pylist()), np.int64, len(stems))
        self.stem_kinds = np.bincount(stem_of, minlength=len(stems))
        bucket_core = _buckets(cores.to_pylist())
        bucket_odd = _buckets(["=" + x for x in shapes])
        bucket_stem = _buckets(["<" + x for x in stems.to_pylist()])
        n = np.maximum(counts, 1)
        shares = [_buckets([f"={name}{k}" for k in range(11)])[np.minimum(10, 10 * self.numbers[c] // n)] for name, c in (("odd", "n_odd"), ("again", "n_again"))]
        many = self.stem_words > 1
        owners = np.concatenate([owner, has_odd // tall, self.stem_text[many], np.arange(at), np.arange(at)])
        buckets = np.concatenate([bucket_core[has_core], bucket_odd[has_odd % tall], bucket_stem[self.stem[many]], *shares])
        pairs = np.unique(owners * BUCKETS + buckets)
        self.owner, self.bucket = pairs // BUCKETS, pairs % BUCKETS

    def of_stems(self) -> list[np.ndarray]:
        """Of every stem here: key, documents, distinct words of documents, how
        often they meet another of the document, and different words."""
        some = np.unique(self.stem)
        sums = [np.bincount(self.stem, x, len(self.stem_keys)).astype(np.int64)[some] for x in (None, self.stem_words, self.stem_words * (self.stem_words - 1))]
        return [self.stem_keys[some], *sums, self.stem_kinds[some]]


# what a text holds of stems, and, with a part's first text, what the part holds
OF_TEXT = "stems array<long>, stem_words array<int>, "
OF_PART = ("part_stem", "part_docs", "part_words", "part_meets", "part_kinds")


def _lists(rows: int, offsets: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, t)) for v, t in zip(values, (pa.int64(), pa.int32()), strict=False)]


def read_numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, draw, the numbers, the stems of which a text has several words)
    of every whole text, and the sums over stems of each part of the texts."""
    schema = "doc_id long, draw long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", " + OF_TEXT + ", ".join(f"{c} array<long>" for c in OF_PART)
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows in slices(b.column(1), PART):
                part = b.slice(first, rows)
                m = Measures(part.column(1))
                many = m.stem_words > 1
                offsets = np.searchsorted(m.stem_text[many], np.arange(rows + 1))
                once = np.append(0, np.full(rows, len(np.unique(m.stem))))  # with the first text
                sums = [pa.ListArray.from_arrays(pa.array(once, pa.int32()), pa.array(x, pa.int64())) for x in m.of_stems()]
                columns = [part.column(0), part.column(2), *(pa.array(m.numbers[c], pa.int64()) for c in NUMBERS), *_lists(rows, offsets, m.stem_keys[m.stem[many]], m.stem_words[many]), *sums]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text", draw_of()).mapInArrow(read, schema)


def draw_of() -> Column:
    return F.xxhash64("doc_id", "text", F.lit("sample")).alias("draw")


def crowded_stems(numbers: DataFrame) -> DataFrame:
    """(stem) of the crowded stems, at most ``CROWDED``."""
    rows = numbers.filter(F.size("part_stem") > 0).select(F.explode(F.arrays_zip(*OF_PART)).alias("x")).select("x.*")
    stems = rows.groupBy(F.col("part_stem").alias("stem")).agg(F.sum("part_docs").alias("docs"), F.sum("part_words").alias("words"), F.sum("part_meets").alias("meets"), F.max("part_kinds").alias("kinds"))
    n = F.col("n_distinct").cast("double")
    total, square = numbers.agg(F.coalesce(F.sum(n), F.lit(0.0)), F.coalesce(F.sum(n * n), F.lit(0.0))).first()
    even = F.pow(F.col("words") / F.lit(max(total, 1.0)), F.lit(2.0)) * square
    crowd = (F.col("meets") >= CROWD * even) & (F.col("docs") >= CROWD_DOCS) & (F.col("kinds") >= CROWD_WORDS) & (F.col("meets") >= 2 * F.col("docs"))
    return stems.filter(crowd).orderBy(F.col("meets").desc(), "stem").limit(CROWDED).select("stem")


def with_crowds(numbers: DataFrame, stems: np.ndarray) -> DataFrame:
    """The numbers with n_crowd, a text's distinct words of crowded stems, of stems of which it has several."""
    sent = numbers.sparkSession.sparkContext.broadcast(np.sort(stems))  # at most CROWDED
    kept = ["doc_id", "draw", *NUMBERS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("stems")
            sizes = np.diff(np.asarray(lists.offsets))
            hit = np.isin(np.asarray(lists.flatten()), sent.value)
            n = np.bincount(np.repeat(np.arange(b.num_rows), sizes)[hit], np.asarray(b.column("stem_words").flatten())[hit], b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n)], [*kept, "n_crowd"])

    schema = "doc_id long, draw long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", n_crowd long"
    return numbers.select(*kept, "stems", "stem_words").mapInArrow(run, schema)


def read_features(docs: DataFrame) -> DataFrame:
    """(draw, features) of whole texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows in slices(b.column(0), PART):
                m = Measures(b.column(0).slice(first, rows))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(m.owner, np.arange(rows + 1)), pa.int32()), pa.array(m.bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(first, rows), lists], ["draw", "features"])

    return docs.select("text", draw_of()).mapInArrow(read, "draw long, features array<int>")


def read_scores(docs: DataFrame, scorers: dict[str, np.ndarray], crowded: np.ndarray) -> DataFrame:
    """(doc_id, the numbers, n_crowd and a score for each scorer) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((scorers, np.sort(crowded)))  # weights of fixed size, and at most CROWDED stems
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in (*NUMBERS, "n_crowd")) + "".join(f", {t}_score double" for t in scorers)
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, stems = sent.value
        for b in batches:
            for first, rows in slices(b.column(1), PART):
                m = Measures(b.column(1).slice(first, rows))
                hit = (m.stem_words > 1) & np.isin(m.stem_keys[m.stem], stems)
                crowd = np.bincount(m.stem_text[hit], m.stem_words[hit], rows).astype(np.int64)
                columns = [b.column(0).slice(first, rows), *(pa.array(m.numbers[c], pa.int64()) for c in NUMBERS), pa.array(crowd)]
                for w in weights.values():
                    columns.append(pa.array(1 / (1 + np.exp(-np.clip(np.bincount(m.owner, w[m.bucket], rows) + w[BUCKETS], -500, 500)))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(read, schema)


def labellers() -> dict[str, dict[str, Column]]:
    """task -> labeller -> vote over the columns of ``measures``."""
    n = F.greatest(F.col("n"), F.lit(1))
    share = lambda c: F.col(c) / n
    return {
        "form": {
            "odd": _vote(share("n_odd") > 0.3, share("n_odd") < 0.05),
            "kinds": _vote(F.col("kinds_odd") > 0.1 * n + 3, F.col("kinds_odd") < 0.02 * n + 3),
            "again": _vote(share("n_again") > 0.2, share("n_again") < 0.05),
            "distinct": _vote((F.col("n") > 15) & (share("n_distinct") < 0.15), share("n_distinct") > 0.3),
            "length": _vote(F.col("n") < 15, F.col("n") >= 30),
        },
        "language": {
            "listed": _vote(F.col("n_toxic") > 0, F.lit(False)),
            "kinds": _vote(F.col("kinds_toxic") > 1, (F.col("kinds_toxic") == 0) & (F.col("n") >= 20)),
            "listed_share": _vote(share("n_toxic") > 0.004, F.col("n_toxic") == 0),
            "crowd": _vote(F.col("n_crowd") > 1, F.col("n_crowd") == 0),
            "crowd_share": _vote(100 * F.col("n_crowd") >= F.greatest(F.col("n_distinct"), F.lit(150)), F.col("n_crowd") == 0),
        },
    }


def em(votes: np.ndarray, counts: np.ndarray, steps: int = 200) -> np.ndarray:
    """Posterior of good for each vote pattern.

    ``votes``: (patterns, labellers) in -1, 0, 1. Starts from the share of good
    votes, so that good is the side that the labellers call good; counts are
    smoothed, so a vote never seen is not impossible."""
    if not len(votes):
        return np.zeros(0)
    good, bad = (votes == 1).sum(1), (votes == -1).sum(1)
    post = np.where(good + bad, (good + 0.5) / (good + bad + 1.0), 0.5)
    # one bad vote among labellers that mostly look elsewhere is a strong hint at first
    post = np.where(bad > 0, np.minimum(post, 0.4 ** bad), post)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(steps):
        mass = np.stack([counts * post, counts * (1 - post)])
        prior = (mass.sum(1) + 1) / (counts.sum() + 2)
        chance = (np.einsum("kp,plv->klv", mass, onehot) + 0.1) / (mass.sum(1)[:, None, None] + 0.3)
        logs = np.log(prior)[:, None] + np.einsum("plv,klv->kp", onehot, np.log(chance))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


def posteriors(measured: DataFrame, votes: dict[str, Column]) -> tuple[DataFrame, Column]:
    """(pattern, posterior), at most 3^labellers rows, and the pattern of a document."""
    pattern = F.concat_ws(",", *[v.cast("string") for v in votes.values()])
    rows = measured.groupBy(pattern.alias("pattern")).count().collect()
    table = np.array([[int(x) for x in r["pattern"].split(",")] for r in rows]).reshape(len(rows), len(votes))
    post = em(table, np.array([r["count"] for r in rows], float))
    spark = measured.sparkSession
    return spark.createDataFrame([(r["pattern"], float(p)) for r, p in zip(rows, post, strict=True)], "pattern string, posterior double"), pattern


def fit(bucket: np.ndarray, sizes: np.ndarray, soft: np.ndarray, weight: np.ndarray, steps: int = 400, rate: float = 0.1, penalty: float = 0.3) -> np.ndarray:
    """Weights (BUCKETS, then the bias) of a logistic regression on soft labels, by
    Adam over all rows; ``sizes`` features each, one row after the other, which
    count by ``weight``. Features of few rows tell rows apart, not classes: one
    below ``FEATURE_ROWS`` rows, or two of small samples, has no weight."""
    share = weight / weight.sum()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    often = np.bincount(bucket, minlength=BUCKETS)[bucket] >= max(2, min(FEATURE_ROWS, len(sizes) // 400))
    owner, bucket = owner[often], bucket[often]
    used, place = np.unique(bucket, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    m, r = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[place], len(sizes)) + b
        gap = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - soft) * share
        g = np.append(np.bincount(place, gap[owner], len(used)) + penalty * w / weight.sum(), gap.sum())
        m, r = 0.9 * m + 0.1 * g, 0.99 * r + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(r / (1 - 0.99**step)) + 1e-12)
        w, b = w - move[:-1], b - move[-1]
    out = np.zeros(BUCKETS + 1)
    out[used], out[BUCKETS] = w, b
    return out


def drawn(numbers: DataFrame, sample: int) -> DataFrame:
    """(draw, weight): for every vote pattern of all tasks, the draws to sample.

    At most 3^labellers patterns, and about twice ``sample`` draws in all."""
    pattern = F.concat_ws(";", *[v.cast("string") for votes in labellers().values() for v in votes.values()])
    named = numbers.select("draw", pattern.alias("strata"))
    counts = named.groupBy("strata").agg(F.count(F.lit(1)).alias("n"))
    total, patterns = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = min(LEAST, sample // max(patterns, 1))
    rate = F.least(F.lit(1.0), F.greatest(F.lit(sample / max(total, 1)), F.lit(float(least)) / F.col("n")))
    rates = counts.select("strata", rate.alias("rate"))
    part = F.pmod("draw", F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    return named.join(F.broadcast(rates), "strata").filter(part).select("draw", (1 / F.col("rate")).alias("weight")).dropDuplicates(["draw"])


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, a posterior and a score for each task, kept."""
    with_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured = keep(read_numbers(narrow), "classifier-measures")
    crowded = crowded_stems(measured).toPandas()["stem"].to_numpy(np.int64)  # at most CROWDED
    numbers = keep(with_crowds(measured, crowded), "classifier-numbers")
    wanted = keep(drawn(numbers, sample), "classifier-draws")
    part = narrow.withColumn("draw", draw_of()).join(F.broadcast(wanted.select("draw")), "draw", "left_semi")  # about 2 x sample draws
    # texts alike in id and text share a draw and are one text to the fit
    learnt = keep(read_features(part.select("doc_id", "text")).dropDuplicates(["draw"]), "classifier-sample").join(F.broadcast(wanted), "draw")
    votes_of = numbers.join(F.broadcast(wanted.select("draw")), "draw", "left_semi").dropDuplicates(["draw"]).drop("doc_id")
    learnt = keep(learnt.join(votes_of, "draw"), "classifier-learnt")
    posts, scorers = {}, {}
    for task, votes in labellers().items():
        post, pattern = posteriors(numbers, votes)
        posts[task] = F.broadcast(post), pattern  # at most 3^labellers rows
        rows = learnt.withColumn("pattern", pattern).join(posts[task][0], "pattern").orderBy("draw").select("features", "posterior", "weight").toArrow()  # at most 2 x sample rows
        if rows.num_rows:
            features = rows.column("features").combine_chunks()
            scorers[task] = fit(np.asarray(features.flatten()).astype(np.int64), np.diff(np.asarray(features.offsets)), rows.column("posterior").to_numpy(), rows.column("weight").to_numpy())
    out = read_scores(narrow, scorers, crowded)
    for task, (post, pattern) in posts.items():
        out = out.withColumn("pattern", pattern).join(post, "pattern", "left").drop("pattern").withColumnRenamed("posterior", f"{task}_posterior")
        if task not in scorers:  # nothing was sampled
            out = out.withColumn(f"{task}_score", F.col(f"{task}_posterior"))
    least = F.least(*[F.col(f"{t}_score") for t in labellers()])
    return out.select("doc_id", *[f"{t}_{x}" for t in labellers() for x in ("posterior", "score")], least.alias("score"), (least >= 0.5).alias("kept"))
