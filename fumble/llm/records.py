"""Length-delimited binary records of token ids, with a separate offset index.

A shard file is a row of records, in ascending doc_id order over the shards:

    length of payload  unsigned 64 bit
    masked checksum of these 8 bytes  unsigned 32 bit
    payload: doc_id signed 64 bit, flags 8 bit (1: doc_id is null; 2: ids have 16 bits), ids
    masked checksum of the payload  unsigned 32 bit

All numbers are little-endian; a masked checksum is crc32 rotated right by 15
bits plus 0xA282EAD8. The index is a Parquet table (shard, path, position,
doc_id, offset, bytes, n_tokens) for reads in any order. Every attempt of a task
writes a file under a name of its own and the index names the files of the
attempts that Spark took, so what a lost or doubled task left is never read;
files lie in the folder that all executors share.

Defined results: a null or empty text is a record with the end id alone; null
ids come first; rows that repeat a doc_id are records of their own, side by
side; an empty table writes no records and gives no rows; other columns are
not read. A record that fails a checksum raises.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fumble.llm.shared import frame_of, keep, shared_path, trimmed, with_package
from fumble.llm.tokens import encoder, slices

END = 2
HEAD, FLAGGED = struct.Struct("<QI"), struct.Struct("<qB")
INDEX = "shard int, path string, position long, doc_id long, offset long, bytes long, n_tokens long"
INDEX_TYPES = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
READ = "shard:Int64 position:Int64 doc_id:Int64 local_start:Int64 n_tokens:Int64 ids_crc32:Int64"
ROWS = "shard int, position long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record; ids below 65536 take 16 bits each."""
    short = not len(ids) or int(ids.max()) < 1 << 16
    payload = FLAGGED.pack(doc_id or 0, (doc_id is None) + 2 * short) + ids.astype("<u2" if short else "<u4").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = FLAGGED.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=FLAGGED.size).astype("<u4")


def read_record(f) -> bytes | None:
    """The next payload of an open file, checked; None at its end."""
    head = f.read(HEAD.size)
    if not head:
        return None
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length is damaged")
    body = f.read(size + 4)
    if len(body) != size + 4 or masked(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("a record is damaged")
    return body[:-4]


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, file: str, out: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every document's ids below ``out``; returns the index, which is kept at ``out``/index."""
    spark = docs.sparkSession
    with_package(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = TaskContext.get().partitionId(), encoder(file, False)
        fs, folder = place(out)
        fs.create_dir(f"{folder}/records", recursive=True)
        own = f"records/{shard:06d}-{uuid.uuid4().hex}.rec"
        at = position = 0
        with fs.open_output_stream(f"{folder}/{own}", buffer_size=1 << 20) as f:
            for b in batches:
                for first, rows in slices(b.column(1)):
                    part = b.slice(first, rows)
                    ids, sizes = enc.encode(part.column(1))
                    index, done = [], 0
                    for doc, n in zip(part.column(0).to_pylist(), sizes, strict=True):
                        data = frame(doc, np.append(ids[done : done + n], end))
                        done += n
                        f.write(data)
                        index.append((shard, own, position, doc, at, len(data), int(n) + 1))
                        at, position = at + len(data), position + 1
                    cols = zip(zip(*index, strict=True), INDEX_TYPES, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], [x.split()[0] for x in INDEX.split(", ")])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    narrow = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    narrow.mapInArrow(trimmed(write), INDEX).write.parquet(f"{out}/index")
    return spark.read.schema(INDEX).parquet(f"{out}/index")


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """Every record of the files named by the index, read and checked: shard,
    position, doc_id, local_start (ids before it in its shard), n_tokens, ids_crc32."""
    with_package(spark)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = place(out)
        for shard, path in (x for f in frames for x in zip(f["shard"], f["path"], strict=True)):
            rows, before, position = [], 0, 0
            with fs.open_input_stream(f"{folder}/{path}", buffer_size=1 << 20) as f:
                while (payload := read_record(f)) is not None:
                    doc, ids = parse(payload)
                    rows.append((shard, position, doc, before, len(ids), zlib.crc32(ids.tobytes())))
                    before, position = before + len(ids), position + 1
                    if len(rows) == 10_000:
                        yield frame_of(rows, READ)
                        rows = []
            yield frame_of(rows, READ)

    files = spark.read.schema(INDEX).parquet(f"{out}/index").select("shard", "path").distinct()
    return files.repartition(max(1, files.count())).mapInPandas(read, ROWS)  # a task per file


def read_one(out: str, path: str, offset: int) -> tuple[int | None, np.ndarray]:
    """A shuffled read: the record that the index places at ``offset`` of ``path``."""
    fs, folder = place(out)
    with fs.open_input_file(f"{folder}/{path}") as f:
        f.seek(offset)
        return parse(read_record(f))


def with_starts(rows: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The window holds one row per shard file."""
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return rows.join(firsts, "shard").select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_records(docs: DataFrame, file: str, out: str | None = None, end: int = END) -> DataFrame:
    """Write the files and their index, read the files back: one row per document."""
    spark = docs.sparkSession
    out = out or shared_path(spark, "token-records")
    write_records(docs, file, out, end)
    return with_starts(keep(read_records(spark, out), "records-read"))
