"""Column expressions and Arrow functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """Make a function of pandas series a function of columns.

    The schema is read when the columns are given, on the driver: workers import the
    module without a session.
    """

    def wrap(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def call(*cols) -> Column:
            return F.pandas_udf(fn, schema)(*cols)

        return call

    return wrap
