"""An engine: one prepared graph, the tiles in use, and programs run on it one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.prepared import GraphError, PreparedGraph

Program = Callable[[PreparedGraph], DataFrame]


@dataclass(frozen=True)
class Hooks:
    """What happens around a run: ``start`` may change the graph, ``after`` a program's result; ``end`` sees all results."""

    start: Callable[[PreparedGraph], PreparedGraph] = lambda g: g
    before: Callable[[str], None] = lambda name: None
    after: Callable[[str, DataFrame], DataFrame] = lambda name, result: result
    end: Callable[[dict[str, DataFrame]], None] = lambda results: None


class Engine:
    """Programs are functions from the graph to a DataFrame with a vid; they run in the order they were added."""

    def __init__(self, graph: PreparedGraph, tiles: Iterable[int] | None = None, hooks: Hooks = Hooks()):
        self.graph, self.hooks = graph, hooks
        self._programs: dict[str, Program] = {}
        self.tiles = range(graph.tiles) if tiles is None else tiles

    @property
    def tiles(self) -> list[int]:
        return self._tiles

    @tiles.setter
    def tiles(self, ids: Iterable[int]) -> None:
        ids = list(ids)
        if any(b <= a for a, b in zip(ids, ids[1:])):
            raise GraphError(f"tile ids do not increase: {ids}")
        if any(not 0 <= i < self.graph.tiles for i in ids):
            raise GraphError(f"tile ids outside 0 to {self.graph.tiles - 1}: {ids}")
        self._tiles = ids

    @property
    def programs(self) -> list[str]:
        return list(self._programs)

    def add(self, name: str, program: Program) -> Engine:
        if name in self._programs:
            raise GraphError(f"program added twice: {name}")
        self._programs[name] = program
        return self

    def remove(self, name: str) -> Engine:
        if self._programs.pop(name, None) is None:
            raise GraphError(f"no such program: {name}")
        return self

    def run(self) -> dict[str, DataFrame]:
        """Every program's rows for the vertices of the tiles in use; messages still come from all tiles."""
        graph = self.hooks.start(self.graph)
        results = {}
        for name, program in self._programs.items():
            self.hooks.before(name)
            found = program(graph)
            if len(self.tiles) < graph.tiles:
                found = found.join(graph.parts.where(F.col("tid").isin(self.tiles)).select("vid"), "vid", "left_semi")
            results[name] = self.hooks.after(name, found)
        self.hooks.end(results)
        return results
