"""Ordered stages of named window expressions.

A feature that reads another window feature (MACD signal over MACD, volatility over returns)
lives one stage later. Every stage is ONE ``select`` over the same ``SeriesWindow``, so Catalyst
keeps a single exchange + sort for the whole bundle and stacks the Window operators on top.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame


class Stages:
    def __init__(self, stages: Iterable[dict[str, Column]] | None = None):
        self.stages: list[dict[str, Column]] = [dict(s) for s in (stages or [])]

    def at(self, level: int) -> dict[str, Column]:
        while len(self.stages) <= level:
            self.stages.append({})
        return self.stages[level]

    def add(self, level: int, cols: dict[str, Column]) -> Stages:
        self.at(level).update(cols)
        return self

    def __add__(self, other: Stages) -> Stages:
        out = Stages(self.stages)
        for i, s in enumerate(other.stages):
            out.add(i, s)
        return out

    def shifted(self, levels: int) -> Stages:
        """The same stages starting ``levels`` stages later."""
        return Stages([{} for _ in range(levels)] + self.stages)

    @property
    def depth(self) -> int:
        return len(self.stages)

    @property
    def names(self) -> list[str]:
        return [n for s in self.stages for n in s]

    def apply(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            if not s:
                continue
            keep = [c for c in df.columns if c not in s]
            df = df.select(*keep, *[c.alias(n) for n, c in s.items()])
        return df
