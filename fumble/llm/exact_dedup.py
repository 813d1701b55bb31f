"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of each partition, merged by adding counters, names the
only digests that can be frequent. Their groups are counted exactly; these
verified winners (at most ``counters`` + 1 rows, whatever the input) are
broadcast, so that rows of very large groups are answered where they are read
and never shuffled. All other digests form groups of less than
``2 / (counters + 1)`` of the rows and go through an ordinary shuffle.

Defined results: a null text counts as empty, and empty texts form one group;
an empty table gives no rows; rows that repeat a ``doc_id`` with the same text
count in ``group_size`` and share one verdict; with only null ids in a group
``keep_id`` is null and the rows stay. Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumble.llm.shared import id_key, keep, scratch, taken, with_package
from fumble.llm.url_filter import LOWER, UPPER

COUNTERS = 1024


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # bytes.lower() changes A-Z only
        out = [hashlib.sha256((t or "").encode().lower()).digest() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of every whole text after lower-casing A-Z."""
    with_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_digests, "doc_id long, digest binary")


def misra_gries(counters: int):
    """A partition function: digests -> at most ``counters`` (digest, count) rows.

    Each count is short of the truth by at most rows / (counters + 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}
        for b in batches:
            for d, n in b["digest"].map(bytes).value_counts().items():
                held[d] = held.get(d, 0) + int(n)
            if len(held) > counters:
                cut = int(np.partition(np.fromiter(held.values(), np.int64), len(held) - counters - 1)[len(held) - counters - 1])
                held = {d: n - cut for d, n in held.items() if n > cut}
        yield pd.DataFrame({"digest": list(held), "n": list(held.values())}, columns=["digest", "n"]).astype({"n": "int64"})

    return run


def frequent_digests(narrow: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates: every digest on at least 2 / (counters + 1) of the rows, and
    at most ``counters`` + 1 digests, since their counts sum to the row count."""
    part = narrow.select("digest").mapInPandas(misra_gries(counters), "digest binary, n long")
    merged = part.groupBy("digest").agg(F.sum("n").alias("n"))
    return merged.filter(F.col("n") * (counters + 1) >= narrow.count()).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = keep(digests(docs, id_col, text_col), "dedup-digests")
    groups = lambda df: df.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    candidates = frequent_digests(narrow, counters)
    winners = keep(groups(narrow.join(F.broadcast(candidates), "digest", "left_semi")), "dedup-winners")
    heavy = narrow.join(F.broadcast(winners), "digest")
    light = narrow.join(F.broadcast(winners), "digest", "left_anti")
    light = light.join(groups(light), "digest")
    return heavy.unionByName(light).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns. A row is met again by its
    doc_id and digest; of rows that have both alike one stays."""
    with scratch(docs.sparkSession):
        judged = exact_dedup(docs, id_col, text_col, **options)
        rows = judged.groupBy(id_key(F.col("doc_id")).alias("id"), "text_sha256").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("kept").cast("long")).alias("copies"))
        decided = keep(rows, "dedup-decided", outlives=True)
    folded = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    return taken(docs, [id_key(F.col(id_col).cast("long")), F.sha2(folded.cast("binary"), 256)], decided)
