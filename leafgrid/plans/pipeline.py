"""Pipelines: ordered, named DataFrame transforms that a config can describe."""

from __future__ import annotations

import copy
import inspect
import json
import re
import tomllib
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import aggregate, classify, extract, geometry, trainable
from ..runtime import read_text, write_text
from .deferred import ConfigError, Graph

Transform = Callable[[DataFrame], DataFrame]


class Registry:
    """Factories by namespace and name."""

    def __init__(self):
        self.found: dict[str, dict[str, Callable]] = {}

    def register(self, name: str, space: str = "factory") -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            self.found.setdefault(space, {})[name] = f
            return f

        return add

    def get(self, name: str, space: str = "factory") -> Callable:
        known = self.found.get(space, {})
        if name not in known:
            raise ValueError(f"no {space} named {name!r}; there are {', '.join(sorted(known)) or 'none'}")
        return known[name]


registry = Registry()
for _name, _f in {
    "pdf-extractor": extract.extract_boxes,
    "mask-classifier": classify.mask_classify,
    "multi-mask-classifier": classify.multi_mask_classify,
    "dummy-classifier": classify.dummy_classify,
    "random-classifier": classify.random_classify,
    "trained-classifier": classify.trained_classify,
    "simple-aggregator": aggregate.aggregate,
    "markdown": aggregate.markdown,
    "text-classifier": trainable.label_boxes,
    "merge-boxes": geometry.merge_boxes,
    "reading-order": geometry.reading_order,
}.items():
    registry.register(_name)(_f)


@registry.register("saved", "model")
def saved_model(path: str, spark: SparkSession, folder: str = "") -> trainable.Model:
    """A model saved at a path, which is taken from the config's folder unless it is absolute or has a scheme."""
    path = path if path.startswith("/") or "://" in path or not folder else f"{folder.rstrip('/')}/{path}"
    found = trainable.Model.load(spark, path)
    if found is None:
        raise ValueError(f"no model is saved at {path}")
    return found


class Pipeline:
    """Named transforms in order; a disabled one is left out of the plan."""

    def __init__(self, processing: Mapping[str, str] | None = None):
        self._pipes: list[tuple[str, Transform, dict]] = []
        self._disabled: set[str] = set()
        self.processing = dict(processing or {})

    @property
    def pipe_names(self) -> list[str]:
        return [n for n, *_ in self._pipes if n not in self._disabled]

    @property
    def disabled(self) -> list[str]:
        return [n for n, *_ in self._pipes if n in self._disabled]

    def has_pipe(self, name: str) -> bool:
        return any(n == name for n, *_ in self._pipes)

    def get_pipe(self, name: str) -> Transform:
        for n, f, _ in self._pipes:
            if n == name:
                return f
        raise ValueError(f"no pipe named {name!r}; there are {', '.join(n for n, *_ in self._pipes) or 'none'}")

    @staticmethod
    def create_pipe(factory: str, config: Mapping[str, Any] | None = None) -> Transform:
        """A transform from a registered factory and its arguments, checked against its signature."""
        f, config = registry.get(factory), dict(config or {})
        known = inspect.signature(f).parameters
        if not any(p.kind is p.VAR_KEYWORD for p in known.values()) and (odd := set(config) - set(known)):
            raise ValueError(f"{factory}: unknown argument {', '.join(sorted(odd))}")
        return lambda df: f(df, **config)

    def add_pipe(self, factory: str | Transform, name: str | None = None, config: Mapping[str, Any] | None = None, first: bool = False, before: str | None = None, after: str | None = None) -> Transform:
        """Add a pipe at the end, or at the one place asked for."""
        if sum([first, before is not None, after is not None]) > 1:
            raise ValueError("give one of first, before and after")
        pipe = self.create_pipe(factory, config) if isinstance(factory, str) else factory
        name = name or (factory if isinstance(factory, str) else factory.__name__)
        if self.has_pipe(name):
            raise ValueError(f"there is a pipe named {name!r} already")
        names = [n for n, *_ in self._pipes]
        for other in (before, after):
            if other is not None and other not in names:
                raise ValueError(f"no pipe named {other!r}")
        at = 0 if first else names.index(before) if before is not None else names.index(after) + 1 if after is not None else len(names)
        self._pipes.insert(at, (name, pipe, {"factory": factory if isinstance(factory, str) else None, "config": dict(config or {})}))
        return pipe

    @contextmanager
    def select_pipes(self, enable: list[str] | None = None, disable: list[str] | None = None) -> Iterator[Pipeline]:
        """Only some pipes for a while."""
        names = [n for n, *_ in self._pipes]
        if enable is None and disable is None:
            raise ValueError("give enable or disable")
        if odd := [n for n in [*(enable or []), *(disable or [])] if n not in names]:
            raise ValueError(f"no pipe named {', '.join(odd)}")
        if set(enable or ()) & set(disable or ()):
            raise ValueError("a pipe can't be both enabled and disabled")
        kept = self._disabled
        self._disabled = {n for n in names if n not in enable} if enable is not None else kept | set(disable)
        try:
            yield self
        finally:
            self._disabled = kept

    def __call__(self, df: DataFrame) -> DataFrame:
        for name, pipe, _ in self._pipes:
            if name not in self._disabled:
                df = df.transform(pipe)
        return df

    def set_processing(self, **conf: str | int) -> Pipeline:
        """Spark settings for runs: arrow_batch_rows, shuffle_partitions or any full key with dots as __."""
        known = {"batch_size": "spark.sql.execution.arrow.maxRecordsPerBatch", "arrow_batch_rows": "spark.sql.execution.arrow.maxRecordsPerBatch", "shuffle_partitions": "spark.sql.shuffle.partitions"}
        self.processing.update({known.get(k, k.replace("__", ".")): str(v) for k, v in conf.items()})
        return self

    def configure(self, spark: SparkSession) -> None:
        for k, v in self.processing.items():
            spark.conf.set(k, v)

    def config(self) -> dict[str, Any]:
        """What from_config takes."""
        if odd := [n for n, _, made in self._pipes if made["factory"] is None]:
            raise ValueError(f"pipes without a factory have no config: {', '.join(odd)}")
        return {"pipeline": [n for n, *_ in self._pipes], "disabled": self.disabled, "processing": self.processing, "components": {n: {"@factory": made["factory"], **made["config"]} for n, _, made in self._pipes}}

    @classmethod
    def from_config(cls, config: Mapping[str, Any], overrides: Mapping[str, Any] | None = None, spark: SparkSession | None = None, folder: str = "") -> Pipeline:
        """Build from a config; overrides are dotted paths below components.

        Arguments may be factories and references (see ``Graph``); a component may be a reference to
        another part of the config.  Pipes keep what they were written as, for ``config``.
        """
        config = copy.deepcopy(dict(config))
        parts = config.setdefault("components", {})
        for path, value in (overrides or {}).items():
            *names, last = path.split(".")
            at: Any = parts
            for n in names:
                at = at.setdefault(n, {})
            at[last] = value
        graph = Graph(config, registry.get, {"spark": spark, "folder": folder})
        out = cls(config.get("processing"))
        for name in config.get("pipeline", parts):
            path = f"components.{name}"
            written = graph.at(path)
            while isinstance(written, str) and (m := re.fullmatch(r"\$\{([^${}]+)\}", written)):
                path = m[1].strip()
                written = graph.at(path, f"components.{name}")
            space, factory, args = graph.arguments(path)
            if space != "factory":
                raise ConfigError(path, "a pipe is made by @factory")
            try:
                out.add_pipe(factory, name, args)
            except (KeyError, ValueError) as e:
                raise ConfigError(f"components.{name}", str(e)) from e
        out._disabled = set(config.get("disabled", ()))
        return out

    def save(self, spark: SparkSession, folder: str) -> None:
        """The config and, beside it, the weights of every model among the arguments, on any file system that Spark writes."""
        made = self.config()
        for name, part in made["components"].items():
            for arg, value in part.items():
                if isinstance(value, trainable.Model):
                    part[arg] = {"@model": "saved", "path": f"weights/{name}/{arg}"}
                    value.save(spark, f"{folder.rstrip('/')}/weights/{name}/{arg}")
        write_text(spark, f"{folder.rstrip('/')}/config.json", json.dumps(made, indent=2))

    @classmethod
    def load(cls, spark: SparkSession, folder: str, overrides: Mapping[str, Any] | None = None) -> Pipeline:
        """What save wrote, with its weights."""
        return cls.from_config(json.loads(read_text(spark, f"{folder.rstrip('/')}/config.json")), overrides, spark, folder)

    def to_disk(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.config(), f, indent=2)

    @classmethod
    def from_disk(cls, path: str, overrides: Mapping[str, Any] | None = None) -> Pipeline:
        return load(path, overrides)


def load(config: str | Mapping[str, Any], overrides: Mapping[str, Any] | None = None) -> Pipeline:
    """A pipeline from a config, or from a JSON or TOML file."""
    if isinstance(config, str):
        with open(config, "rb") as f:
            config = tomllib.load(f) if config.endswith(".toml") else json.load(f)
    return Pipeline.from_config(config, overrides)
