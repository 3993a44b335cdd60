"""Column expressions for the scalar helpers that pipelines commonly need, and named reducers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_words(text: Column) -> Column:
    """Lower-cased text split on single spaces."""
    return F.split(F.lower(text), " ", -1)


def is_blank(text: Column) -> Column:
    """True if no character lies above U+0020."""
    return ~text.rlike(r"[^\x00-\x20]")


def shift_char(text: Column, by: int = 1) -> Column:
    """The character ``by`` code points after the first one."""
    return F.chr(F.ascii(text) + F.lit(by))


#: Reducers that Catalyst can combine before the shuffle.
_REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "avg": F.avg,
    "and": F.bool_and,
    "or": F.bool_or,
    "first": F.any_value,
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
    # Concatenation has no natural order in a shuffle, so the values are ordered.
    "concat": lambda c: F.array_join(F.array_sort(F.collect_list(c.cast("string"))), ""),
}


def named_reducer(reducer: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """``"sum"`` and the like, or any function from a value column to an aggregate column."""
    if callable(reducer):
        return reducer
    if reducer not in _REDUCERS:
        raise ValueError(f"unknown reducer {reducer!r}; known: {', '.join(sorted(_REDUCERS))}")
    return _REDUCERS[reducer]
