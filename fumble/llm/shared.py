"""Helpers shared by the operators: tables, the shared folder, text rules."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fumble.session import ensure_checkpoint_dir, remove_path, session_with, ship_package  # noqa: F401

# The word rule of every operator.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``keep`` writes inside are removed at the end, but for those
    that outlive it; what is returned must rest on the latter alone."""
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in mine:
            remove_path(spark, path)


def keep(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: cuts the
    lineage, survives lost executors and is computed a single time. A table that
    ``outlives`` the innermost ``scratch`` belongs to the one around it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    scopes = _SCOPES.get()[: -1 if outlives else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.kept_at = path
    return back


def through(df: DataFrame, spark: SparkSession) -> DataFrame:
    """A table of ``keep`` as a table of another session."""
    back = spark.read.schema(df.schema).parquet(df.kept_at)
    back.kept_at = df.kept_at
    return back


def release(df: DataFrame) -> None:
    """Remove a table of ``keep`` that nothing rests on any more."""
    for scope in _SCOPES.get():
        if df.kept_at in scope:
            scope.remove(df.kept_at)
    remove_path(df.sparkSession, df.kept_at)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where ``df`` has a column of that name."""
    used, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def id_key(doc_id: Column) -> Column:
    """A text that tells ids apart, null too, and is never null."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("null"))


def taken(docs: DataFrame, keys: list[Column], decided: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as was decided.

    ``decided`` is a written table with a row for each key: its values, none of
    them null, in the order of ``keys``, then how many rows of ``docs`` have the
    key and how many copies are taken of them together. Rows alike in the key
    share these: each the whole part, and the first rows one more. Only keys
    whose copies do not part evenly have their rows numbered, by the exchange
    that joins them. Spark sends ``decided`` to the rows where its written size
    is small and deals both out by the key else."""
    *k, rows, copies, place, copy = names = free_names(docs, *[f"key{i}" for i in range(len(keys))], "rows", "copies", "place", "copy")
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    left = decided.toDF(*names[:-2]).filter(F.col(copies) > 0)
    even = F.col(copies) % F.col(rows) == 0
    most, uneven = left.agg(F.max(F.ceil(F.col(copies) / F.col(rows))), F.count_if(~even)).first()
    keyed = docs.select(*columns, *[c.alias(n) for c, n in zip(keys, k, strict=True)])

    def times(joined: DataFrame, each: Column) -> DataFrame:
        if (most or 0) <= 1:
            return joined.filter(each > 0).select(*columns)
        each = F.when(each > 0, F.sequence(F.lit(1), each.cast("int"))).otherwise(F.array().cast("array<int>"))
        return joined.withColumn(copy, F.explode(each)).select(*columns)

    out = times(keyed.join(left.filter(even), k), F.col(copies) / F.col(rows))
    if not uneven:
        return out
    some = keyed.join(left.filter(~even), k).withColumn(place, F.row_number().over(Window.partitionBy(*k).orderBy(copies)))
    extra = F.when(F.col(place) <= F.col(copies) % F.col(rows), 1).otherwise(0)
    return out.unionByName(times(some, F.floor(F.col(copies) / F.col(rows)) + extra))


def with_package(spark: SparkSession) -> None:
    """Python workers import this package; ship it with the application."""
    ship_package(spark)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives what its allocators still hold back to the
    system at the end, as Spark keeps the worker, idle, for tasks of later stages."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """What this process has freed and its allocators still hold goes to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def words(text: Column) -> Column:
    """Words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def text_digest(text_col: str) -> Column:
    """SHA-256 of a text; a null text has the digest of an empty one, as it is judged alike."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def frame_of(rows: list[tuple], columns: str):
    """A pandas frame of rows with columns "name:dtype ..."; whole numbers beside
    nulls stay exact, which pandas would otherwise turn into floats."""
    import pandas as pd

    named = [c.split(":") for c in columns.split()]
    values = list(zip(*rows, strict=True)) if rows else [()] * len(named)
    return pd.DataFrame({n: pd.array(list(v), dtype=t) if t != "object" else pd.Series(list(v), dtype=object) for (n, t), v in zip(named, values, strict=True)})
