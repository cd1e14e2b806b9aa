"""Array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once.  Without it the optimizer may copy
    an array's expression into a lambda, where it runs for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space."""
    runs = lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n)))))
    return bind(words, runs)
