"""A registry of nodes: features under their ids, with what they depend on.

A node is a function of a catalogue to a feature frame; a catalogue of any
registered set of nodes builds those that are asked for and what they need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans import vitals
from tidelog.plans.features import COLUMNS, FEATURES, Catalog


class DuplicateNode(ValueError):
    """A node with this id is registered already."""


class UnknownDependency(ValueError):
    """A node depends on an id that isn't registered."""


class DependencyCycle(ValueError):
    """Nodes depend on each other in a circle."""


@dataclass(frozen=True)
class Node:
    id: str
    build: Callable[[Catalog], DataFrame]
    needs: tuple[str, ...] = ()


@dataclass
class Registry:
    nodes: dict[str, Node] = field(default_factory=dict)

    def register(self, node: Node) -> None:
        if node.id in self.nodes:
            raise DuplicateNode(node.id)
        self.nodes[node.id] = node

    def ordered(self, ids: Iterable[str] | None = None) -> list[str]:
        """The ids and all they need, each after its dependencies: first the nodes
        without any, then what each of these in turn makes ready; equal choices
        stand in the order of registration."""
        place = {name: i for i, name in enumerate(self.nodes)}
        asked = list(self.nodes if ids is None else ids)
        graph: dict[str, tuple[str, ...]] = {}
        open_ = [("the caller", name) for name in asked]
        while open_:
            by, name = open_.pop()
            if name not in self.nodes:
                raise UnknownDependency(f"{by} needs {name}")
            if name not in graph:
                graph[name] = self.nodes[name].needs
                open_ += [(name, need) for need in graph[name]]
        sorter = TopologicalSorter(graph)
        try:
            sorter.prepare()
        except CycleError as e:
            raise DependencyCycle(" -> ".join(e.args[1])) from e
        out = sorted(sorter.get_ready(), key=place.get)
        for name in out:  # grows while it is read
            sorter.done(name)
            out += sorted(sorter.get_ready(), key=place.get)
        return out

    def run(self, cat: Catalog, ids: Iterable[str] | None = None) -> DataFrame:
        """UNION ALL of the frames of the nodes that are asked for (all, where none
        is named), with their ids; what they need is built, but not returned."""
        wanted = None if ids is None else list(ids)
        out = None
        for name in self.ordered(wanted):
            if wanted is not None and name not in wanted:
                continue
            frame = self.nodes[name].build(cat).select(F.lit(name).alias("feature_id"), *COLUMNS)
            out = frame if out is None else out.unionByName(frame)
        if out is None:
            raise UnknownDependency("no node is registered")
        return out


#: Composites and what they are made of.
NEEDS = {
    "focus_score": ("context_switch_rate",),
    "distraction_score": ("context_switch_rate",),
    "fatigue_index": ("focus_score",),
    "cognitive_load": ("meeting_density", "context_switch_rate", "notification_pressure"),
    "deep_work_score": ("focus_score", "context_switch_rate"),
    "attention_stability": ("focus_score", "context_switch_rate"),
    "sustained_load": ("stress_index", "fatigue_index", "meeting_density"),
}
#: Daily vitals: their frame and the column that is their value.
VITALS = {
    "resting_hr_vs_baseline": (vitals.resting_heart_rate, "delta"),
    "hrv_vs_baseline": (vitals.hrv_vs_baseline, "delta"),
    "sleep_minutes": (vitals.sleep_stages, "total_min"),
    "night_spo2": (vitals.night_spo2, "mean"),
    "respiratory_rate_vs_baseline": (vitals.respiratory_rate, "delta"),
    "wrist_temperature_vs_baseline": (vitals.wrist_temperature, "delta"),
}


def _vital(build: Callable[[DataFrame], DataFrame], value: str) -> Callable[[Catalog], DataFrame]:
    none = "cast(array() as array<struct<id:string,share:double>>)"

    def node(cat: Catalog) -> DataFrame:
        rows = build(cat.obs).filter(F.col(value).isNotNull())
        return rows.select("subject_id", "w_end", F.col(value).cast("double").alias("value"), "confidence", "evidence", F.expr(none).alias("factors"))

    return node


def full_catalog() -> Registry:
    """All window features and daily vitals."""
    out = Registry()
    for name in FEATURES:
        out.register(Node(name, lambda cat, name=name: cat[name], NEEDS.get(name, ())))
    for name, (build, value) in VITALS.items():
        out.register(Node(name, _vital(build, value)))
    return out
