"""Transforms by type: what a typed part of a triple is stored as, and how it is read back.

A transform is a pair of functions from a column to a column. The built-in ones keep the order of values; a caller's
own, of a type's name, stand in their place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encoding as E

Transform = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def _whole(kind: str) -> Transform:
    return E.encode_int, lambda e: E.decode_int(e).cast(kind)


def _real(kind: str, precision: int) -> Transform:
    return lambda v: E.encode_float(v, precision), lambda e: E.decode_float(e).cast(kind)


#: Transforms by type. Unsigned types need the next wider signed one of Spark.
BUILT_IN: dict[str, Transform] = {
    "INT32": _whole("int"), "INT64": _whole("long"), "UINT32": _whole("long"), "UINT64": _whole("decimal(20,0)"), "FLOAT": _real("float", 9), "DOUBLE": _real("double", 17),
    "BYTE": (lambda c: c, lambda c: c), "POINTER": (lambda c: c, lambda c: c),
}


def _apply(df: DataFrame, types: Mapping[str, str], own: Mapping[str, Transform] | None, way: int) -> DataFrame:
    known = BUILT_IN | dict(own or {})
    missing = {t for t in types.values() if t not in known}
    if missing:
        raise ValueError(f"no transform of {sorted(missing)}")
    return df.withColumns({c: known[t][way](F.col(c)) for c, t in types.items()})


def encoded(df: DataFrame, types: Mapping[str, str], own: Mapping[str, Transform] | None = None) -> DataFrame:
    """``df`` with each column of ``types`` (name: type) as it is stored; ``own`` transforms stand before the built-in ones."""
    return _apply(df, types, own, 0)


def decoded(df: DataFrame, types: Mapping[str, str], own: Mapping[str, Transform] | None = None) -> DataFrame:
    """What :func:`encoded` made, read back."""
    return _apply(df, types, own, 1)
