"""File sources and sinks.

Pair files are headerless two-column CSV. The dialect matters: quotes are
doubled inside quoted fields (``escape='"'``) and a field may hold a carriage
return (``multiLine``); Spark reads an unquoted empty field as null and keeps
``NA`` as text, while pandas turns both into the text ``nan`` — parity with
that is a flag (``null_as_nan``).

Records end with a line feed only, so a carriage return inside a quoted field
stays. A file read with ``multiLine`` cannot be split into several tasks;
Parquet is the default sink of every job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip

PAIR_ORDER = ("correct", "typos")
NULL_MARK = "\u0000"
# The strings pandas' CSV reader treats as missing by default.
PANDAS_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SWAPPED_ORDER = ("typos", "correct")


def read_pairs(spark: SparkSession, path: str, columns: tuple[str, str] = PAIR_ORDER,
               null_as_nan: bool = False) -> tuple[DataFrame, DataFrame]:
    """A1/A2: pair CSV scan; both fields stripped (Unicode whitespace).

    Returns (pairs, quarantine). Rows with a missing field go to quarantine,
    unless ``null_as_nan`` reproduces the pandas behaviour (text ``nan``).
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (spark.read.schema(schema).option("header", False).option("escape", '"')
           .option("multiLine", True).option("lineSep", "\n").option("mode", "PERMISSIVE")
           # unquoted empty -> null, quoted "" -> '' (the default maps both to null)
           .option("nullValue", NULL_MARK).csv(path))
    cols = []
    for c in columns:
        v = F.col(c)
        if null_as_nan:
            v = F.when(v.isNull() | v.isin(*PANDAS_NA), F.lit("nan")).otherwise(v)
        cols.append(py_strip(v).alias(c))
    df = raw.select(*cols)
    ok = F.col(columns[0]).isNotNull() & F.col(columns[1]).isNotNull()
    return df.filter(ok), df.filter(~ok)


def write_pairs(pairs: DataFrame, path: str, mode: str = "append", columns: tuple[str, str] = PAIR_ORDER) -> None:
    """A4: headerless quoted CSV, appended; row order is not defined."""
    (pairs.select(*columns).write.mode(mode).option("header", False).option("escape", '"')
     .option("quoteAll", True)
     # Spark's writer trims fields unless told not to
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A5: JSON lines with a declared schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """A6 as JSON lines; nulls are written, so a field is never guessed to be absent."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_records(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Record tables as Parquet, appended per evaluation."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_keyed(df: DataFrame, path: str, key: tuple[str, ...]) -> None:
    """A6, A7 repeatably: the rows of each key replace those that the table holds
    for it; other keys stay. A key is a folder, so the same evaluation written
    twice, by a retry or by hand, reads back once. Keys are no empty texts."""
    (df.repartition(*key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path))


def write_scalars(metrics: DataFrame, path: str, key: tuple[str, ...] = ("run_id", "eval_idx")) -> None:
    """One row per run and evaluation, every other column a scalar, written
    in long form (run_id, eval_idx, metric, value); see ``write_keyed``."""
    names = [c for c in metrics.columns if c not in key]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")
    write_keyed(metrics.select(*key, rows).select(*key, "x.metric", "x.value"), path, key)


def read_scalars(spark: SparkSession, path: str, key: str = "run_id string, eval_idx int") -> DataFrame:
    return spark.read.schema(f"{key}, metric string, value double").parquet(path)
