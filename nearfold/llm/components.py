"""Connected components whose rounds go to the folder of an operator call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import connected_components
from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str = "edges") -> DataFrame:
    """(v, component) for every vertex of edges (a, b) that has another; the component is its least vertex."""

    def save(df: DataFrame, k: int) -> DataFrame:
        saved = scratch.save(df, f"{label}{k}")
        if k > 1:
            scratch.drop(f"{label}{k - 1}")
        return saved

    return connected_components(edges, save=save)
