"""Compiled programs over streams: programs are stateless projections, so a stream takes the plan of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.program import Node, project


def score_stream(stream: DataFrame, outputs: dict[str, Node]) -> DataFrame:
    """A readStream DataFrame with one column per program output."""
    return project(stream, outputs)
