"""An application: a main function over named resources, run once or whenever its sources change."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..streaming import live


class Resources:
    """Values by name for the length of a run; context managers are entered, and left in reverse order."""

    def __init__(self) -> None:
        self._stack, self._values = contextlib.ExitStack(), {}

    def provide(self, name: str, value: Any) -> None:
        self._values[name] = self._stack.enter_context(value) if hasattr(value, "__enter__") and hasattr(value, "__exit__") else value

    def use(self, name: str) -> Any:
        if name not in self._values:
            raise KeyError(f"no resource {name!r} was provided")
        return self._values[name]

    def close(self) -> None:
        self._stack.close()


class App:
    """main(app) gets what it needs through ``use`` and registers what it reads through ``source``.

    ``lifespan`` is a generator function of the resources: it provides them before its yield and may clean up after it.
    """

    def __init__(self, spark: SparkSession, main: Callable[[App], dict[str, int]], lifespan: Callable[[Resources], Iterator[None]] | None = None, **settings: Any):
        self.spark, self.main, self.lifespan, self.settings = spark, main, lifespan, settings
        self.roots: list[str] = []
        self.force = False
        self.last_stats: dict[str, int] | None = None
        self._resources: Resources | None = None

    def use(self, name: str) -> Any:
        if self._resources is None:
            raise RuntimeError("resources exist only during a run")
        return self._resources.use(name)

    def source(self, root: str) -> DataFrame:
        """The files below root; live mode watches every root that was read."""
        if root not in self.roots:
            self.roots.append(root)
        return files.items(self.spark, root)

    def update(self, force: bool = False) -> dict[str, int]:
        """One run; its counts are also kept as last_stats. Resources are closed even where it fails."""
        self._resources, self.force = Resources(), force
        phase = self.lifespan(self._resources) if self.lifespan else iter(())
        try:
            next(phase, None)
            self.last_stats = self.main(self)
            return self.last_stats
        finally:
            try:
                next(phase, None)
            finally:
                self._resources.close()
                self._resources, self.force = None, False

    def run_live(self, state: str, interval: str = "2 seconds", force: bool = False) -> StreamingQuery:
        """A first run, which registers the sources, then one for every change of their listings until the query is stopped."""
        self.update(force)
        return live.watch(self.spark, self.roots, lambda *_: self.update(), state, interval)
