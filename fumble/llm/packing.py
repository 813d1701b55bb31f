"""Vector best-fit packing of token sequences.

Documents become pieces of at most ``tokens`` ids. Pieces are dealt evenly
over the tasks, row by row, so no key can fill one of them, and each task
packs its rows in shards of at most ``shard`` pieces. In a shard, pieces go
from large to small into the open sequence that still has room in every
dimension - tokens, documents, and attention cost (squared lengths) - and that
leaves the smallest weighted norm of residual capacities ("norm"), or has the
largest weighted dot product with the piece ("dot"). A shard wastes less than
one open sequence or so, whatever the number of shards.

Defined results: a null or empty text is a piece with the end id alone; rows
that repeat a doc_id are packed each on its own; an empty table gives no rows;
other columns are not read. A retried task deals and packs its rows alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumble.llm.shared import keep, trimmed, with_package
from fumble.llm.tokens import encoder, slices

END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = ", sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and the weight of each dimension when choosing.

    Attention below tokens^2 limits sequences of several pieces; a piece that
    costs more stands alone. The defaults leave only tokens binding, as squared
    lengths sum to no more than the square of their sum."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    rule: str = "norm"

    def __post_init__(self):
        if min(self.tokens, self.documents, self.attention) < 1 or self.rule not in ("norm", "dot"):
            raise ValueError("every capacity is at least 1, and the rule is norm or dot")


def pieces(docs: DataFrame, file: str, tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text."""
    with_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file, True)
        for b in batches:
            for first, rows in slices(b.column(1)):
                part = b.slice(first, rows)
                ids, sizes = enc.encode(part.column(1))
                out, at = [], 0
                for doc, n in zip(part.column(0).to_pylist(), sizes, strict=True):
                    own = np.append(ids[at : at + n], END).astype("<u4")
                    at += n
                    for k, s in enumerate(range(0, len(own), tokens)):
                        x = own[s : s + tokens].tobytes()
                        out.append((doc, k, s, len(x) // 4, zlib.crc32(x), x))
                cols = list(zip(*out, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep_n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays(arrays[:keep_n], names[:keep_n])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(trimmed(cut), PIECES + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, by vector best-fit from large to small."""
    n = len(lengths)
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights) / full**2
    left = np.empty((3, n))
    bins, offsets, used = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        fits = np.flatnonzero((left[0, :used] >= need[0]) & (left[1, :used] >= 1) & (left[2, :used] >= need[2]))
        if len(fits):
            room = left[:, fits]
            if cap.rule == "norm":
                b = fits[np.argmin(weights @ (room - need[:, None]) ** 2)]
            else:
                b = fits[np.argmax((weights * need) @ room)]
        else:
            b, used = used, used + 1
            left[:, b] = full
        offsets[i] = cap.tokens - left[0, b]
        left[:, b] -= need
        bins[i] = b
    return bins, offsets


def pack(cut: DataFrame, capacity: Capacity = Capacity(), shard: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns ``length`` and any others)."""
    with_package(cut.sparkSession)
    n = cut.count()
    tasks = max(1, min(n // 1024, max(cut.sparkSession.sparkContext.defaultParallelism, -(-n // (16 * shard)))))
    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Packs full shards, at the last also the rest, which else waits for more."""
            nonlocal done, held, rows
            table = pa.Table.from_batches(held) if rows else None
            end = rows if last else rows - rows % shard
            for first in range(0, end, shard):
                part = table.slice(first, min(shard, end - first))
                b, o = best_fit(part["length"].to_numpy(), capacity)
                part = part.append_column("sequence_id", pa.array((task << 40) + done + b)).append_column("offset", pa.array(o))
                yield from part.combine_chunks().to_batches()
                done += int(b.max()) + 1
            held, rows = (table.slice(end).to_batches() if rows > end else []), rows - end

        for f in batches:
            held.append(f)
            rows += f.num_rows
            if rows >= shard:
                yield from flush(False)
        yield from flush(True)

    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + PLACES
    return cut.repartition(tasks).mapInArrow(trimmed(place), schema).select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, file: str, capacity: Capacity = Capacity(), with_ids: bool = False, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    return pack(keep(pieces(docs, file, capacity.tokens, with_ids=with_ids, **options), "pack-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed token arrays; at most ``tokens`` ids are gathered in a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
