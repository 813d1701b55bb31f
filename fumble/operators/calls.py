"""A caller's own Python step over rows, in Arrow batches, with an error per row.

``step`` gets lists, one for each input column, and returns a list with one
result for each row. A call that raises, returns another number of results or
one that is not of the stated kind is halved until the failing row stands
alone; that row gets the error, all others their results. So a step that fails
on a few rows costs a few more calls, and no row is lost.

A row's result must not depend on the rows it is called with: batches part the
rows as Spark's partitions do. A retried task calls the step again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CALL_ROWS = 64


def settled(call: Callable[[int, int], list], n: int, call_rows: int = CALL_ROWS) -> tuple[list, list]:
    """(results, errors) of rows 0 to n; ``call(first, last)`` gives those of some rows."""
    results: list = [None] * n
    errors: list = [None] * n
    todo = [(i, min(i + call_rows, n)) for i in range(0, n, call_rows)][::-1]
    while todo:
        first, last = todo.pop()
        try:
            got = list(call(first, last))
            if len(got) != last - first:
                raise ValueError(f"{len(got)} results for {last - first} rows")
            results[first:last] = got
        except Exception as e:  # noqa: BLE001 - whatever the caller's code raises is the row's error
            if last - first == 1:
                errors[first] = f"{type(e).__name__}: {e}"
            else:
                middle = (first + last) // 2
                todo += [(middle, last), (first, middle)]
    return results, errors


def with_step(df: DataFrame, step: Callable[..., list], inputs: list[str], name: str, kind: T.DataType,
              check: Callable[[object], object], call_rows: int = CALL_ROWS, error: str = "error") -> DataFrame:
    """``df`` with the step's results in column ``name`` and its errors in column
    ``error``; of the two one is null in every row, unless a result itself is.
    ``check`` returns a result as it is stored, or raises."""
    if clash := {name, error} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind), T.StructField(error, T.StringType())])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = {c: b.column(c).to_pylist() for c in inputs}
            results, errors = settled(lambda i, j: [check(x) for x in step(**{c: v[i:j] for c, v in lists.items()})], b.num_rows, call_rows)
            columns = [*b.columns, pa.array(results, arrow), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
