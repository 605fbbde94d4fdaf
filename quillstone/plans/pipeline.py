"""Pipelines: nodes from datasets to datasets, run in the order of their dependencies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from quillstone.plans.catalog import Catalog


@dataclass(frozen=True)
class Node:
    label: str
    fn: Callable
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    description: str = ""
    params: Any = None


def bind(kind: type, values: dict) -> Any:
    """A parameter record from configured values; unknown names are errors."""
    if not is_dataclass(kind):
        raise TypeError(f"{kind} is no parameter record")
    if unknown := set(values) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown parameters of {kind.__name__}: {', '.join(sorted(unknown))}")
    return kind(**values)


@dataclass
class Pipeline:
    name: str
    nodes: list[Node] = field(default_factory=list)

    def add_node(self, label: str, fn: Callable, inputs: tuple[str, ...], outputs: tuple[str, ...], description: str = "", params: Any = None) -> Pipeline:
        made = {o for n in self.nodes for o in n.outputs}
        if twice := made & set(outputs):
            raise ValueError(f"written by two nodes: {', '.join(sorted(twice))}")
        self.nodes.append(Node(label, fn, tuple(inputs), tuple(outputs), description, params))
        return self

    def order(self) -> list[Node]:
        """Nodes after those whose outputs they read."""
        made = {o: n for n in self.nodes for o in n.outputs}
        done: list[Node] = []
        state: dict[str, int] = {}

        def visit(n: Node) -> None:
            if state.get(n.label) == 2:
                return
            if state.get(n.label) == 1:
                raise ValueError(f"{self.name} has a cycle through {n.label}")
            state[n.label] = 1
            for x in n.inputs:
                if x in made:
                    visit(made[x])
            state[n.label] = 2
            done.append(n)

        for n in self.nodes:
            visit(n)
        return done

    def run(self, catalog: Catalog) -> list[str]:
        """Labels of the nodes run; a node of several outputs returns as many DataFrames."""
        ran = []
        for n in self.order():
            args = [catalog.read(x) for x in n.inputs]
            out = n.fn(*args, n.params) if n.params is not None else n.fn(*args)
            frames = out if isinstance(out, tuple) else (out,)
            if len(frames) != len(n.outputs):
                raise ValueError(f"{n.label} made {len(frames)} of {len(n.outputs)} datasets")
            for name, df in zip(n.outputs, frames):
                catalog.write(name, df)
            ran.append(n.label)
        return ran

    def mermaid(self) -> str:
        edges = [f"  {x} --> {n.label}" for n in self.nodes for x in n.inputs] + [f"  {n.label} --> {o}" for n in self.nodes for o in n.outputs]
        return "\n".join(["flowchart LR", *edges])


@dataclass
class Registry:
    """Pipelines by name; no name runs all, in the order they were registered."""

    catalog: Catalog
    pipelines: dict[str, Pipeline] = field(default_factory=dict)

    def register(self, pipeline: Pipeline) -> Pipeline:
        if pipeline.name in self.pipelines:
            raise ValueError(f"pipeline {pipeline.name} is registered")
        self.pipelines[pipeline.name] = pipeline
        return pipeline

    def run(self, name: str | None = None) -> dict[str, list[str]]:
        if name is not None and name not in self.pipelines:
            raise KeyError(f"no pipeline {name}")
        chosen = self.pipelines.values() if name is None else [self.pipelines[name]]
        return {p.name: p.run(self.catalog) for p in chosen}
