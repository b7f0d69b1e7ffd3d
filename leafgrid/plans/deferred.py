"""Configs as graphs: nested factories and references, each built once, when it is needed."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Mapping
from typing import Any

_REFERENCE = re.compile(r"\$\{([^${}]+)\}")


class ConfigError(ValueError):
    """What is wrong and the path of the setting where it is."""

    def __init__(self, path: str, what: str):
        super().__init__(f"{path}: {what}")
        self.path = path


class Graph:
    """The settings of a config by their dotted paths.

    A mapping with a key ``@space`` is a factory of that space with its arguments, which may be such
    mappings again.  ``${path}`` as a whole value is the object built at that path, the same object
    for each reference; inside a longer text it is put in as text.  Building is lazy and every path
    is built once; circles, unknown paths, unknown factories and wrong arguments are errors that name
    their path.
    """

    def __init__(self, config: Mapping[str, Any], find: Callable[[str, str], Callable], given: Mapping[str, Any] | None = None):
        self.config, self.find, self.given = config, find, dict(given or {})
        self.built: dict[str, Any] = {}
        self.open: list[str] = []

    def at(self, path: str, asker: str = "") -> Any:
        """The plain setting at a path."""
        value: Any = self.config
        for name in path.split("."):
            if isinstance(value, Mapping) and name in value:
                value = value[name]
            elif isinstance(value, list) and name.isdigit() and int(name) < len(value):
                value = value[int(name)]
            else:
                raise ConfigError(asker or path, f"there is no setting {path}")
        return value

    def get(self, path: str, asker: str = "") -> Any:
        """What is built from the setting at a path."""
        if path in self.built:
            return self.built[path]
        if path in self.open:
            raise ConfigError(asker or path, "refers to itself: " + " -> ".join([*self.open[self.open.index(path) :], path]))
        self.open.append(path)
        try:
            self.built[path] = self._make(self.at(path, asker), path)
        finally:
            self.open.pop()
        return self.built[path]

    def arguments(self, path: str) -> tuple[str, str, dict[str, Any]]:
        """(space, factory, built arguments) of the factory at a path."""
        value = self.at(path)
        marks = [k for k in value if k.startswith("@")] if isinstance(value, Mapping) else []
        if len(marks) != 1:
            raise ConfigError(path, "needs one factory")
        return marks[0][1:], value[marks[0]], {k: self.get(f"{path}.{k}", path) for k in value if not k.startswith("@")}

    def _make(self, value: Any, path: str) -> Any:
        if isinstance(value, str):
            if m := _REFERENCE.fullmatch(value):
                return self.get(m[1].strip(), path)
            return _REFERENCE.sub(lambda m: str(self.get(m[1].strip(), path)), value)
        if isinstance(value, list):
            return [self.get(f"{path}.{i}", path) for i in range(len(value))]
        if not isinstance(value, Mapping):
            return value
        if not any(k.startswith("@") for k in value):
            return {k: self.get(f"{path}.{k}", path) for k in value}
        space, name, args = self.arguments(path)
        return call(path, self.find, space, name, args, self.given)


def call(path: str, find: Callable[[str, str], Callable], space: str, name: str, args: Mapping[str, Any], given: Mapping[str, Any] | None = None) -> Any:
    """A factory's object; given values are handed to parameters of their names that the config leaves open."""
    try:
        f = find(name, space)
        known = inspect.signature(f).parameters
        if not any(p.kind is p.VAR_KEYWORD for p in known.values()) and (odd := set(args) - set(known)):
            raise ValueError(f"unknown argument {', '.join(sorted(odd))}")
        return f(**{k: v for k, v in (given or {}).items() if k in known and k not in args}, **args)
    except ConfigError:
        raise
    except (TypeError, ValueError) as e:
        raise ConfigError(path, str(e)) from e
