"""Reuse of column expressions.

Building a large expression takes one call to the JVM per node. An expression that depends
only on column names and plain parameters is the same every time, so it is built once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext


def built_once(fn: Callable) -> Callable:
    """Cache a function of hashable parameters that returns columns, per JVM."""
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        key = (id(SparkContext._gateway), args)
        if key not in cache:
            cache[key] = fn(*args)
        return cache[key]

    return wrapper
