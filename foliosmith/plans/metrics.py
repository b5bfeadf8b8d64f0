"""Counts of a run that its own jobs make: metrics are observed on rows as they are written, so that none is counted by a job of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F


class Metrics:
    """Named counts; each is there once the rows that it watches have been written."""

    def __init__(self):
        self._watched: list[Observation] = []

    def watch(self, frame: DataFrame, **counts: Column) -> DataFrame:
        """The frame, whose next job sums the counts up."""
        seen = Observation()
        self._watched.append(seen)
        return frame.observe(seen, *[F.sum(F.coalesce(count.cast("bigint"), F.lit(0))).alias(name) for name, count in counts.items()])

    def told(self) -> dict[str, int]:
        """The sum of each count over all that watch it; waits for rows that are not written yet."""
        out: dict[str, int] = {}
        for seen in self._watched:
            for name, value in seen.get.items():
                out[name] = out.get(name, 0) + (value or 0)
        return out
