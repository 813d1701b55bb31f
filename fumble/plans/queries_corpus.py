"""Registered queries of the ``sample`` and ``corrupt`` jobs (B*, C*)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.noise import keyboard_noise, noise_sql_duckdb
from ..functions.noise_compat import keyboard_noise_compat
from ..operators import corrupt, sample
from ..session import checkpoint_path, cut_lineage, rebalance, spread, text_session
from ..sources.tables import load
from .common import (EXTERNAL_PROB, EXTERNAL_SEED, K_PER_SOURCE, NOISE_IMPL, NOISE_SEED, PROB, SEED, TEST_ROUNDS,
                     all_passages, external_typos, id_sql, passages_sql, u_sql)


def q_sample_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "source"))
    return sample.sample_per_source(docs, k=K_PER_SOURCE, seed=SEED).select("doc_id", "source", F.col("round").cast("int"))


def q_sample_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return sample.sample_rounds(docs, rounds=TEST_ROUNDS, k=K_PER_SOURCE, seed=SEED).select(
        "doc_id", "source", "lang", F.col("round").cast("int"))


def q_shuffle_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return sample.shuffled_head(docs, 50, seed=SEED)


def q_passage_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_passages(spark, sf_dir, trim=False).select("doc_id", "passage")


def q_passage_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_passages(spark, sf_dir, trim=True).select("doc_id", "passage")


def q_keyboard_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 over every whole document text."""
    docs = spread(load(text_session(spark), sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", keyboard_noise(F.col("text"), F.col("doc_id"), prob=PROB, seed=NOISE_SEED, impl=NOISE_IMPL).alias("typos"))


def q_noise_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = all_passages(spark, sf_dir, trim=True)
    return corrupt.noise_variants(p, 3, prob=PROB, seed=NOISE_SEED).select(
        "pair_id", F.col("variant").cast("int"), "typos")


def q_build_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1–C10 for the test split: 10 rounds × 20 documents per source."""
    ok, _quarantine = _built_pairs(spark, sf_dir)
    return ok.select("pair_id", "doc_id", "source", F.col("round").cast("int"), "correct", "typos", "arm")


def _built_pairs(spark: SparkSession, sf_dir: str, answered: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, quarantine); the external arm answers the passages that ``answered`` holds for."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sampled = sample.sample_rounds(docs, rounds=TEST_ROUNDS, k=K_PER_SOURCE, seed=SEED)
    # passages are cropped where the sample is joined, and written once: both arms read them
    passages = cut_lineage(rebalance(corrupt.make_passages(sampled, seed=SEED, trim=True)))
    routed = passages.filter(~corrupt.route_is_noise(F.col("doc_id"), F.col("round"), SEED))
    ext = external_typos(routed if answered is None else routed.filter(answered))
    return corrupt.pairs_of_passages(passages, external=ext, seed=SEED, noise_seed=NOISE_SEED, prob=PROB)


def q_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages routed to the external arm that it did not answer (here,
    those of every 13th document), as rows."""
    _ok, bad = _built_pairs(spark, sf_dir, F.col("doc_id") % 13 != 0)
    return bad.select("pair_id", "doc_id", F.col("round").cast("int"), "arm", F.col("correct"))


def q_quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs were built and how many rejected, per source and arm."""
    ok, bad = _built_pairs(spark, sf_dir, F.col("doc_id") % 13 != 0)
    both = ok.select("source", "arm", F.lit("built").alias("state")).unionByName(bad.select("source", "arm", F.lit("rejected").alias("state")))
    return both.groupBy("source", "arm", "state").agg(F.count(F.lit(1)).alias("n_rows"))


HEAD_ROWS = 50


def q_first_of_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6 + B8 after B4: the first document of the shuffled table, and the head
    of the shuffle of each source, clamped where a source has fewer documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    one = sample.shuffled_head(docs, 1, seed=SEED).select(F.lit("pick").alias("kind"), "source", "doc_id")
    heads = sample.clamped_heads(docs, HEAD_ROWS, seed=SEED).select(F.lit("head").alias("kind"), "source", "doc_id")
    return one.unionByName(heads)


def q_shuffled_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 over B7: every document's pair and the pre-sampled turns of another
    task in one table, with each row's place in a permutation of all."""
    pairs = load(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("key"))
    turns = load(spark, sf_dir, "conversations").select(F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("key"))
    chosen = sample.shuffled_head(turns, PRESAMPLE, seed=SEED, id_col="key")
    return sample.shuffled(sample.labelled_union((pairs, "typo"), (chosen, "capability")), ["key"], seed=SEED).select("position", "task", "key")


def q_disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: every document's side; equal texts are on one side."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return sample.disjoint_split(docs, TEST_SHARE, seed=SEED).select("doc_id", "side")


def q_split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10 counted: test texts that training has too, where both are sampled
    from all documents in rounds of their own, and where the sides are apart."""
    docs = sample.disjoint_split(load(spark, sf_dir, "documents"), TEST_SHARE, seed=SEED)
    docs = cut_lineage(docs.select("doc_id", "source", "side", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text")))
    out = None
    for kind, train, test in (("independent", docs, docs), ("apart", docs.filter("side = 'train'"), docs.filter("side = 'test'"))):
        parts = [sample.sample_rounds(d, rounds, k=K_PER_SOURCE, seed=seed) for d, rounds, seed in ((train, TRAIN_ROUNDS, SEED), (test, TEST_ROUNDS, SEED + 1))]
        one = sample.leaks(*parts).select(F.lit(kind).alias("kind"), "test_texts", "shared_texts")
        out = one if out is None else out.unionByName(one)
    return out


def q_compat_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 ``compat``: every whole document with the draws of one shared generator."""
    docs = spread(load(text_session(spark), sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", keyboard_noise_compat("text", prob=PROB, seed=NOISE_SEED)[0].alias("typos"))


# Documents on which the caller's step raises.
FAILING = 17


def without_e(doc_id: list, text: list) -> list:
    """A caller's step: a document's text, and that without its letters e."""
    for i in doc_id:
        if i % FAILING == 0:
            raise ValueError(f"document {i} cannot be prepared")
    return [(t, t.replace("e", "")) for t in text]


def _prepared_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(load(text_session(spark), sf_dir, "documents").select("doc_id", "source", "text"))
    return corrupt.prepare_rows(docs, without_e, checkpoint_path(spark, f"prepared-{uuid.uuid4().hex}"), inputs=("doc_id", "text"))


def q_prepared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through a caller's step that raises on some of them."""
    return _prepared_rows(spark, sf_dir)[0]


def q_prepared_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the step raised, for each document that it raised on."""
    return _prepared_rows(spark, sf_dir)[1]


def q_prepared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair builder with a caller's own step, upper-casing every passage."""
    def shout(sampled: DataFrame) -> DataFrame:
        return corrupt.make_passages(sampled, seed=SEED).select("doc_id", F.upper(F.translate("passage", "ß", "s")).alias("passage"))

    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return corrupt.apply_prepare(docs, shout)


def q_mixed_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one task and conversations of another, with different
    columns, in one table; what a part lacks is null."""
    pairs = sample.sample_per_source(load(spark, sf_dir, "documents").select("doc_id", "source"), k=K_PER_SOURCE, seed=SEED).select("doc_id", "source")
    chats = load(spark, sf_dir, "conversations").select("conv_id", "role").distinct()
    return sample.labelled_union((pairs, "typo"), (chats, "chat"))


TRAIN_ROUNDS = 100
TEST_SHARE = 0.1
PRESAMPLE = 200_000  # rows of the other task that are mixed in


def q_labelled_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7 + B9: train (100 rounds) and test (10 rounds) samples drawn
    independently, labelled with the task and counted per split."""
    docs = sample.narrow_keys(load(spark, sf_dir, "documents"))
    # counting needs the sampled keys only, no join back to the documents
    train = sample.sampled_keys(docs, rounds=TRAIN_ROUNDS, k=K_PER_SOURCE, seed=SEED).withColumn("split", F.lit("train"))
    test = sample.sampled_keys(docs, rounds=TEST_ROUNDS, k=K_PER_SOURCE, seed=SEED + 1).withColumn("split", F.lit("test"))
    labelled = sample.labelled_union((train, "typo"), (test, "typo"))
    return labelled.groupBy("split", "task").agg(F.count(F.lit(1)).alias("n_rows"))


def q_corruption_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request texts for the passages routed to the external arm."""
    p = all_passages(spark, sf_dir, trim=True)
    routed = p.filter(~corrupt.route_is_noise(F.col("doc_id"), F.lit(0), SEED))
    return corrupt.external_requests(routed)


# ------------------------------------------------------------------ oracles

def _sample_sql(rounds: int | None) -> str:
    if rounds is None:
        return (
            "SELECT doc_id, source, CAST(0 AS INTEGER) AS round FROM ("
            f"SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {u_sql('sample', "'0'", 'doc_id')}, doc_id) AS rn "
            "FROM documents) WHERE rn <= 20"
        )
    return (
        "SELECT doc_id, source, lang, CAST(round AS INTEGER) AS round FROM ("
        f"SELECT doc_id, source, lang, r AS round, row_number() OVER (PARTITION BY source, r ORDER BY {u_sql('sample', 'r', 'doc_id')}, doc_id) AS rn "
        f"FROM documents, range(0, {rounds}) t(r)) WHERE rn <= {K_PER_SOURCE}"
    )


def _sampled_rounds_sql() -> str:
    return (
        "(SELECT d.doc_id, d.source, d.text, s.round FROM documents d JOIN ("
        "SELECT doc_id, round FROM ("
        f"SELECT doc_id, r AS round, row_number() OVER (PARTITION BY source, r ORDER BY {u_sql('sample', 'r', 'doc_id')}, doc_id) AS rn "
        f"FROM documents, range(0, {TEST_ROUNDS}) t(r)) WHERE rn <= {K_PER_SOURCE}) s USING (doc_id))"
    )


def _round_passages_sql(src: str) -> str:
    crop = (
        "substr(text, CAST(" + u_sql("crop", "doc_id", "round") + " % (length(text) - least(1000, length(text)) + 1) AS BIGINT) + 1, "
        "least(1000, length(text)))"
    )
    return (
        "(SELECT pair_id, doc_id, source, round, "
        "array_to_string(list_slice(string_split(p0, ' '), 2, len(string_split(p0, ' ')) - 1), ' ') AS passage FROM "
        f"(SELECT {id_sql('pair', 'doc_id', 'round')} AS pair_id, doc_id, source, round, {crop} AS p0 FROM {src}))"
    )


def _build_pairs_sql(answered: str = "true", rejected: bool = False) -> str:
    sampled = _round_passages_sql(_sampled_rounds_sql())
    ext = noise_sql_duckdb("passage", "CAST(pair_id AS VARCHAR)", prob=EXTERNAL_PROB, seed=EXTERNAL_SEED)
    noisy = noise_sql_duckdb("passage", "CAST(pair_id AS VARCHAR)", prob=PROB, seed=NOISE_SEED)
    route = f"{u_sql('route', 'doc_id', 'round')} <= {int(0.5 * 2**32)}"
    return (
        "SELECT pair_id, doc_id, source, CAST(round AS INTEGER) AS round, "
        "replace(passage, chr(10), ' ') AS correct, replace(typos, chr(10), ' ') AS typos, arm FROM ("
        f"SELECT s.pair_id, s.doc_id, s.source, s.round, s.passage, "
        f"CASE WHEN {route} THEN {noisy} ELSE e.text_with_typos END AS typos, "
        f"CASE WHEN {route} THEN 'keyboard' ELSE 'external' END AS arm "
        f"FROM {sampled} s LEFT JOIN (SELECT pair_id, {ext} AS text_with_typos FROM {sampled} WHERE NOT ({route}) AND {answered}) e USING (pair_id)) "
        f"WHERE passage IS NOT NULL AND typos IS {'' if rejected else 'NOT '}NULL"
    )


def _split_sql(name: str, rounds: int, seed: int) -> str:
    u = u_sql("sample", "r", "doc_id", seed=seed)
    return (
        f"SELECT '{name}' AS split, 'typo' AS task, count(*) AS n_rows FROM ("
        f"SELECT row_number() OVER (PARTITION BY source, r ORDER BY {u}, doc_id) AS rn "
        f"FROM documents, range(0, {rounds}) t(r)) WHERE rn <= {K_PER_SOURCE}"
    )


DIGEST_SQL = "sha256(coalesce(text, ''))"


def _in_test_sql(digest: str) -> str:
    return f"({u_sql('split', digest)} < {int(TEST_SHARE * 2**32)})"


def _leaks_sql(kind: str, train: str, test: str) -> str:
    def part(rounds: int, seed: int, side: str) -> str:
        return (f"(SELECT DISTINCT digest FROM (SELECT digest, row_number() OVER (PARTITION BY source, r ORDER BY {u_sql('sample', 'r', 'doc_id', seed=seed)}, doc_id) AS rn "
                f"FROM (SELECT *, {DIGEST_SQL} AS digest FROM documents), range(0, {rounds}) t(r) WHERE {side}) WHERE rn <= {K_PER_SOURCE})")

    return (f"SELECT '{kind}' AS kind, count(*) AS test_texts, count(*) FILTER (digest IN (SELECT digest FROM {part(TRAIN_ROUNDS, SEED, train)})) AS shared_texts "
            f"FROM {part(TEST_ROUNDS, SEED + 1, test)}")


def oracles() -> dict[str, str]:
    before, after = corrupt.EXTERNAL_REQUEST.split("{text}")
    return {
        "labelled_split_sizes": _split_sql("train", TRAIN_ROUNDS, SEED) + " UNION ALL " + _split_sql("test", TEST_ROUNDS, SEED + 1),
        "sample_by_source": _sample_sql(None),
        "sample_rounds": _sample_sql(TEST_ROUNDS),
        "shuffle_head": (
            f"SELECT doc_id, source FROM documents ORDER BY {u_sql('shuffle', 'doc_id')}, doc_id LIMIT 50"
        ),
        "passage_crop": f"SELECT doc_id, passage FROM {passages_sql(trim=False)}",
        "passage_trim": f"SELECT doc_id, passage FROM {passages_sql(trim=True)}",
        "keyboard_noise": (
            f"SELECT doc_id, {noise_sql_duckdb('text', 'CAST(doc_id AS VARCHAR)', prob=PROB, seed=NOISE_SEED)} AS typos "
            "FROM documents"
        ),
        "noise_variants": (
            "SELECT pair_id, CAST(variant AS INTEGER) AS variant, "
            + noise_sql_duckdb("passage", "CAST(pair_id AS VARCHAR) || ':' || CAST(variant AS VARCHAR)", prob=PROB, seed=NOISE_SEED)
            + f" AS typos FROM {passages_sql(trim=True)}, range(0, 3) t(variant)"
        ),
        "build_pairs": _build_pairs_sql(),
        "quarantine": f"SELECT pair_id, doc_id, round, arm, correct FROM ({_build_pairs_sql('doc_id % 13 <> 0', True)})",
        "quarantine_counts": (
            f"SELECT source, arm, 'built' AS state, count(*) AS n_rows FROM ({_build_pairs_sql('doc_id % 13 <> 0')}) GROUP BY ALL UNION ALL "
            f"SELECT source, arm, 'rejected' AS state, count(*) AS n_rows FROM ({_build_pairs_sql('doc_id % 13 <> 0', True)}) GROUP BY ALL"
        ),
        "first_of_shuffle": (
            f"SELECT 'pick' AS kind, source, doc_id FROM (SELECT source, doc_id FROM documents ORDER BY {u_sql('shuffle', 'doc_id')}, doc_id LIMIT 1) UNION ALL "
            f"SELECT 'head', source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {u_sql('shuffle', 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= {HEAD_ROWS}"
        ),
        "shuffled_training_set": (
            f"SELECT row_number() OVER (ORDER BY {u_sql('shuffle', 'key')}, key) - 1 AS position, task, key FROM (SELECT 'typo' AS task, 'doc:' || doc_id AS key FROM documents "
            f"UNION ALL SELECT 'capability', key FROM (SELECT concat_ws(':', 'turn', conv_id, turn) AS key FROM conversations ORDER BY {u_sql('shuffle', 'key')}, key LIMIT {PRESAMPLE}))"
        ),
        "disjoint_split": f"SELECT doc_id, CASE WHEN {_in_test_sql('digest')} THEN 'test' ELSE 'train' END AS side FROM (SELECT doc_id, {DIGEST_SQL} AS digest FROM documents)",
        "split_leaks": f"{_leaks_sql('independent', 'true', 'true')} UNION ALL {_leaks_sql('apart', 'NOT ' + _in_test_sql('digest'), _in_test_sql('digest'))}",
        "prepared_rows": f"SELECT doc_id, source, replace(text, chr(10), ' ') AS correct, replace(replace(text, 'e', ''), chr(10), ' ') AS typos FROM documents WHERE doc_id % {FAILING} <> 0",
        "prepared_row_errors": f"SELECT doc_id, source, 'ValueError: document ' || doc_id || ' cannot be prepared' AS error FROM documents WHERE doc_id % {FAILING} = 0",
        "prepared_pairs": f"SELECT doc_id, upper(replace(passage, 'ß', 's')) AS passage FROM {passages_sql(trim=True)}",
        "mixed_in": (
            f"SELECT doc_id, source, 'typo' AS task, CAST(NULL AS BIGINT) AS conv_id, CAST(NULL AS VARCHAR) AS role FROM ({_sample_sql(None)}) "
            "UNION ALL SELECT DISTINCT NULL, NULL, 'chat', conv_id, role FROM conversations"
        ),
        "corruption_requests": (
            f"SELECT pair_id, '{before}' || passage || '{after}' AS request FROM {passages_sql(trim=True)} "
            f"WHERE NOT ({u_sql('route', 'doc_id', '0')} <= {int(0.5 * 2**32)})"
        ),
    }


def queries() -> dict:
    return {
        "sample_by_source": q_sample_by_source,
        "sample_rounds": q_sample_rounds,
        "shuffle_head": q_shuffle_head,
        "passage_crop": q_passage_crop,
        "passage_trim": q_passage_trim,
        "keyboard_noise": q_keyboard_noise,
        "noise_variants": q_noise_variants,
        "build_pairs": q_build_pairs,
        "quarantine": q_quarantine,
        "quarantine_counts": q_quarantine_counts,
        "first_of_shuffle": q_first_of_shuffle,
        "shuffled_training_set": q_shuffled_training_set,
        "disjoint_split": q_disjoint_split,
        "split_leaks": q_split_leaks,
        "compat_noise": q_compat_noise,
        "prepared_rows": q_prepared_rows,
        "prepared_row_errors": q_prepared_row_errors,
        "prepared_pairs": q_prepared_pairs,
        "mixed_in": q_mixed_in,
        "corruption_requests": q_corruption_requests,
        "labelled_split_sizes": q_labelled_split_sizes,
    }
