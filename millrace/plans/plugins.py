"""Plugins from a directory: each Python file registers its sources, sinks and transforms by name."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Registry:
    """What plugins offer. Custom sources are Python data sources, which the session takes by their own names."""

    sources: dict[str, type] = field(default_factory=dict)
    transforms: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    sinks: dict[str, Callable[[DataFrame], None]] = field(default_factory=dict)

    def _add(self, kind: dict, name: str, item) -> None:
        if name in kind:
            raise ValueError(f"two plugins offer {name!r}")
        kind[name] = item

    def source(self, cls: type) -> type:
        self._add(self.sources, cls.name(), cls)
        return cls

    def transform(self, name: str) -> Callable:
        return lambda f: (self._add(self.transforms, name, f), f)[1]

    def sink(self, name: str) -> Callable:
        return lambda f: (self._add(self.sinks, name, f), f)[1]


def load(spark: SparkSession, directory: str) -> Registry:
    """Runs ``register(registry)`` of every Python file of a directory, by name; files without it are errors, as are names given twice.

    Plugins are code of the user's own: the directory is one that the user trusts.
    """
    found = Registry()
    for path in sorted(Path(directory).glob("*.py")):
        spec = importlib.util.spec_from_file_location(f"millrace_plugin_{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        if not hasattr(module, "register"):
            raise ValueError(f"{path.name} registers nothing")
        module.register(found)
    for cls in found.sources.values():
        spark.dataSource.register(cls)
    return found
