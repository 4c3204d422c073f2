"""Pipelines: named stages as a tree of edges, each a lazy function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tool = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Junction:
    src: str
    tool: Tool
    dst: str


def end_points(junctions: list[Junction]) -> set[str]:
    return {j.dst for j in junctions} - {j.src for j in junctions}


def origin(junctions: list[Junction]) -> str:
    """The one stage that no edge leads to; every other stage has one edge to it. ValueError otherwise."""
    targets = [j.dst for j in junctions]
    if len(set(targets)) != len(targets):
        raise ValueError(f"more than one edge to {sorted({t for t in targets if targets.count(t) > 1})}")
    roots = {j.src for j in junctions} - set(targets)
    if len(roots) != 1:
        raise ValueError(f"need one origin, found {sorted(roots)}")
    return roots.pop()


def connection(junctions: list[Junction], target: str, start: str | None = None) -> list[Junction]:
    """The edges from the origin (or ``start``) to a target; ValueError if there are none."""
    by, out = {j.dst: j for j in junctions}, []
    start = start or origin(junctions)
    while target != start:
        if target not in by or by[target] in out:
            raise ValueError(f"no way to {target}")
        out.append(by[target])
        target = by[target].src
    return out[::-1]


def as_paths(junctions: list[Junction]) -> dict[str, list[str]]:
    start = origin(junctions)
    return {t: [start, *(j.dst for j in connection(junctions, t))] for t in sorted(end_points(junctions))}


def pretty(junctions: list[Junction]) -> str:
    return "\n".join(" -> ".join(p) for p in as_paths(junctions).values())


def run(junctions: list[Junction], source: DataFrame, targets: list[str] | None = None, fatal: int = 10000, code: str = "max_code") -> dict[str, DataFrame]:
    """The targets' DataFrames (default: all ends). Only needed stages are planned, each once; nothing runs yet.

    Rows whose ``code`` (if there is such a column) reaches ``fatal`` do not enter further stages: each stage's output has only
    rows that came through, the stopped ones are in the stage that stopped them.
    """
    made = {origin(junctions): source}
    for target in targets or sorted(end_points(junctions)):
        for j in connection(junctions, target):
            if j.dst not in made:
                before = made[j.src]
                made[j.dst] = j.tool(before.where(F.coalesce(F.col(code), F.lit(0)) < fatal) if code in before.columns else before)
    return {t: made[t] for t in targets or sorted(end_points(junctions))}


def write(stages: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table for all stages' ``doc_id``, ``stage`` and ``output``, partitioned by stage."""
    for name, df in stages.items():
        df.withColumn("stage", F.lit(name)).write.mode("append").partitionBy("stage").parquet(folder)
