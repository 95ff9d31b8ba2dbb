"""Scoring of streams with a fitted ensemble or member: transforms of single rows, without aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(model, rows: DataFrame) -> DataFrame:
    """rows (a stream or not) with ``probability`` and ``pred``, as an EnsembleModel votes; with ``votes``, as a member says."""
    out = model.scored(rows) if hasattr(model, "scored") else model.votes(rows)
    if out is None:
        raise ValueError("the model has too many nodes to be sent to all tasks of a stream")
    return out
