"""Arrow UDFs that take a few rows at a time.

A batch holds thousands of rows.  As Python objects, and made again into Arrow's, all of them together take many times the
room of their texts; a few rows at once leave only what comes in and goes out.
"""
from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are Python objects at once.
ROWS = 64


def row_udf(one: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A UDF that applies `one` to each row of its columns."""
    out = to_arrow_type(kind)

    def run(*columns: pa.Array) -> pa.Array:
        done = [pa.array([one(*row) for row in zip(*[c.slice(i, ROWS).to_pylist() for c in columns])], out) for i in range(0, len(columns[0]), ROWS)]
        return pa.concat_arrays(done) if done else pa.array([], out)
    run.__name__ = one.__name__  # what plans show
    return F.arrow_udf(run, kind)
