"""Tessera: a small fluent analytics API whose every operator is a Spark DataFrame plan."""

from tessera.operators.dataset import Dataset
from tessera.operators.grouped import GroupedDataset
from tessera.operators.keyed import KeyedDataset
from tessera.session import Context

__all__ = ["Context", "Dataset", "GroupedDataset", "KeyedDataset"]
