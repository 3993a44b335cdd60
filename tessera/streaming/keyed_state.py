"""Keyed state over streams: the counterpart of a per-key state holder, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class KeyState:
    """The key and its current state inside a fold; ``update`` replaces the state."""

    def __init__(self, key: Any, state: Any) -> None:
        self.key, self.state = key, state

    def update(self, state: Any) -> None:
        self.state = state


def fold_by_key(stream: DataFrame, key: str, value: str, state_type: str, fold: Callable[[KeyState, Any], None], zero: Any) -> DataFrame:
    """(key, state) after every micro-batch for the keys it touched; use output mode ``update``.

    The state lives in Spark's state store, so it survives lost executors and restarts from the checkpoint.
    """
    key_type = stream.schema[key].dataType.simpleString()

    def step(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        at = KeyState(keys[0], held.get[0] if held.exists else zero)
        for frame in frames:
            for x in frame[value]:
                fold(at, x)
        held.update((at.state,))
        yield pd.DataFrame({"key": [at.key], "state": [at.state]})

    return stream.groupBy(key).applyInPandasWithState(step, f"key {key_type}, state {state_type}", f"state {state_type}", "update", GroupStateTimeout.NoTimeout)
