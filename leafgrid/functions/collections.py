"""Nested values: flattening, nesting and dotted access, for Python dicts and for columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def flatten_dict(value: Mapping, path: str = "") -> dict[str, Any]:
    """A nested mapping with its paths joined by ``/``."""
    out: dict[str, Any] = {}
    for k, v in value.items():
        at = f"{path}/{k}" if path else str(k)
        out.update(flatten_dict(v, at) if isinstance(v, Mapping) else {at: v})
    return out


def nest_dict(value: Mapping[str, Any]) -> dict[str, Any]:
    """The reverse of flatten_dict; a key with several paths separated by ``|`` goes to each."""
    out: dict[str, Any] = {}
    for keys, v in value.items():
        for key in keys.split("|"):
            *parents, last = key.split("/")
            at = out
            for p in parents:
                at = at.setdefault(p, {})
            at[last] = v
    return out


def flatten(items: Any) -> Iterator[Any]:
    """The leaves of nested lists."""
    for x in items:
        if isinstance(x, list):
            yield from flatten(x)
        else:
            yield x


def get_deep_attr(value: Any, path: str) -> Any:
    """A value by dotted path through attributes, keys and list places."""
    for name in path.split(".") if path else ():
        if isinstance(value, Mapping):
            value = value[name]
        elif isinstance(value, (list, tuple)):
            value = value[int(name)]
        else:
            value = getattr(value, name)
    return value


def set_deep_attr(value: Any, path: str, new: Any) -> None:
    parent, _, name = path.rpartition(".")
    at = get_deep_attr(value, parent)
    if isinstance(at, (list, dict)):
        at[int(name) if isinstance(at, list) else name] = new
    else:
        setattr(at, name, new)


def rows_to_columns(rows: list[Mapping[str, Any]]) -> dict[str, list]:
    """Rows as columns: the first row names the columns; later extra keys go, missing ones are None."""
    return {k: [r.get(k) for r in rows] for k in (rows[0] if rows else ())}


def columns_to_rows(columns: Mapping[str, list]) -> list[dict[str, Any]]:
    return [dict(zip(columns, v, strict=True)) for v in zip(*columns.values(), strict=True)]


def flatten_structs(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested struct columns as plain columns named by their paths."""

    def leaves(schema: StructType, prefix: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, (*prefix, f.name))
            else:
                yield (*prefix, f.name)

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema)])


def nest_columns(df: DataFrame, sep: str = "/") -> DataFrame:
    """Columns named by paths as nested structs."""

    def build(tree: Mapping[str, Any]) -> list[Column]:
        return [F.struct(*build(v)).alias(k) if isinstance(v, dict) else F.col(f"`{v}`").alias(k) for k, v in tree.items()]

    return df.select(*build(nest_dict({c.replace(sep, "/"): c for c in df.columns})))


def pad_2d(values: Column, n: int | Column, pad: Any = 0) -> Column:
    """An array padded on the right to n values."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(n - F.size(values), F.lit(0))))
