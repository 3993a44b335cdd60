"""User-written aggregates with partial states: add rows map-side, merge states after the shuffle."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from typing import Any, Generic, TypeVar

import pyarrow as pa

IN = TypeVar("IN")
STATE = TypeVar("STATE")
OUT = TypeVar("OUT")


class AggFunction(ABC, Generic[IN, STATE, OUT]):
    """zero -> add per row -> merge across partitions -> value. ``merge`` must be associative and commutative."""

    @abstractmethod
    def zero(self) -> STATE: ...

    @abstractmethod
    def add(self, state: STATE, row: IN) -> STATE: ...

    @abstractmethod
    def merge(self, left: STATE, right: STATE) -> STATE: ...

    def value(self, state: STATE) -> OUT | STATE:
        return state


class FoldFunction(AggFunction):
    """An associative two-argument function as an aggregate. A state is a tuple: empty, or of the value so far."""

    def __init__(self, fn: Any) -> None:
        self.fn = fn

    def zero(self) -> tuple:
        return ()

    def add(self, state: tuple, row: Any) -> tuple:
        return (self.fn(state[0], row),) if state else (row,)

    def merge(self, left: tuple, right: tuple) -> tuple:
        return self.add(left, right[0]) if right else left

    def value(self, state: tuple) -> Any:
        return state[0] if state else None


def partial_states(agg: AggFunction, key_columns: list[str], value_of: Any, batches: Iterator[pa.RecordBatch], schema: pa.Schema, flush_at: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Map-side combine: one pickled state per key seen, flushed when more than ``flush_at`` keys are held."""
    held: dict[Any, Any] = {}
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            key = tuple(row[k] for k in key_columns)
            state = held[key] if key in held else agg.zero()
            held[key] = agg.add(state, value_of(row))
        if len(held) > flush_at:
            yield _states_batch(held, key_columns, schema)
            held = {}
    if held:
        yield _states_batch(held, key_columns, schema)


def _states_batch(held: dict[Any, Any], key_columns: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = {k: [key[i] for key in held] for i, k in enumerate(key_columns)}
    columns["state"] = [pickle.dumps(s) for s in held.values()]
    return pa.RecordBatch.from_pydict(columns, schema=schema)


def merged(agg: AggFunction, states: Iterable[bytes]) -> Any:
    total = None
    for i, state in enumerate(states):
        total = pickle.loads(state) if i == 0 else agg.merge(total, pickle.loads(state))
    return agg.value(total)
