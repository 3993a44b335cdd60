"""Names of value encodings and the Spark types that stand for them."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import types as T

#: Encoder name -> Spark type. Variable-length integers are a storage detail that Parquet and Tungsten own.
ENCODERS: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "byte": T.ByteType(),
    "short": T.ShortType(),
    "int": T.IntegerType(),
    "varint": T.IntegerType(),
    "long": T.LongType(),
    "varlong": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "char": T.StringType(),
    "string": T.StringType(),
    "ascii": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "decimal": T.DecimalType(38, 18),
    "binary": T.BinaryType(),
    "int[]": T.ArrayType(T.IntegerType(), False),
    "boolean[]": T.ArrayType(T.BooleanType(), False),
}

_PYTHON: list[tuple[type, T.DataType]] = [
    (bool, T.BooleanType()),
    (int, T.LongType()),
    (float, T.DoubleType()),
    (str, T.StringType()),
    (bytes, T.BinaryType()),
    (datetime.datetime, T.TimestampType()),
    (datetime.date, T.DateType()),
    (decimal.Decimal, T.DecimalType(38, 18)),
]


def to_type(spec: str | T.DataType) -> T.DataType:
    """An encoder name, a DDL string such as ``map<string,int>``, or a DataType."""
    if isinstance(spec, T.DataType):
        return spec
    return ENCODERS.get(spec) or T.DataType.fromDDL(spec)


def infer_type(values: Iterable[Any]) -> T.DataType:
    """The type of the first value that is not null; strings if there is none."""
    for value in values:
        if value is None:
            continue
        if isinstance(value, T.Row):
            return T.StructType([T.StructField(k, infer_type([v])) for k, v in value.asDict().items()])
        if isinstance(value, tuple):
            return T.StructType([T.StructField(f"_{i + 1}", infer_type([v])) for i, v in enumerate(value)])
        if isinstance(value, Mapping):
            return T.MapType(infer_type(value.keys()), infer_type(value.values()))
        if isinstance(value, (list, Iterator)):
            return T.ArrayType(infer_type(value))
        for kind, spark_type in _PYTHON:
            if isinstance(value, kind):
                return spark_type
        raise TypeError(f"no Spark type for {type(value).__name__}; give one explicitly")
    return T.StringType()
