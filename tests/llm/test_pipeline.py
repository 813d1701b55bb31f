import importlib
import re

import corpus_pipeline as CP
from fumble.llm import mixing
from fumble.llm.shared import keep
from tests.llm import test_exact_dedup, test_jaccard_join, test_packing, test_quality_rules
from tests.llm.helpers import SCHEMA, corpus, frame
from tests.llm.test_quality_rules import LABELS, planted

COLUMNS = [f.name for f in SCHEMA]


def test_stages_equal_brute_force(spark, tmp_path):
    rows, labels = planted(3000, 300)  # enough good documents to certify a cutoff
    rows = [(i + 1000, t, lang, "s", 0) for i, t, lang, _, _ in rows] + [r for r in corpus() if r[0] is not None]
    rows = list(dict.fromkeys(rows))
    spark.createDataFrame([(i + 1000, q, t) for i, q, t in labels], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    step = lambda k: keep(CP.STAGES[k][1](spark, docs, sf), "pipeline-test")
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    docs = step(0)
    marked = set(range(4000, 4300))
    left = [r for r in rows if not test_quality_rules.brute(r)[-1] and r[0] not in marked]
    assert ids(docs) == sorted(r[0] for r in left) and docs.columns == COLUMNS

    docs = step(1)
    stay = {x[0] for x in test_exact_dedup.brute(left) if x[3]}
    left = [r for r in left if r[0] in stay]
    assert ids(docs) == sorted(stay) and docs.columns == COLUMNS

    docs = step(2)
    least = {x[0] for x in test_jaccard_join.brute(left) if x[0] == x[2]}
    left = [r for r in left if r[0] in least]
    assert ids(docs) == sorted(least) and docs.columns == COLUMNS

    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    docs = step(3)
    times = ids(docs)
    assert docs.columns == COLUMNS and {i: times.count(i) for i in set(times)} == {i: c for i, c in want.items() if c}
    text = {r[0]: r[1] for r in rows}
    assert all(r.text == text[r.doc_id] for r in docs.collect())

    got = CP.STAGES[4][1](spark, docs, sf).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == test_packing.brute_pieces([(i, text[i]) for i in times], 2048)
    assert CP.run(spark, sf).count() == got.count()


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert CP.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered_once():
    entry = importlib.import_module("__spark_entry__")
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()
