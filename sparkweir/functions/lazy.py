"""Pandas functions that are made when first used, as making one needs a session."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def pandas_function(kind: str):
    """Like pandas_udf, for modules that are imported before there is a session."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
