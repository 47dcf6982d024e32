"""Ordered lists of steps over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Link:
    step: Step
    priority: int = 100
    should_run: Callable[[DataFrame], bool] = field(default=lambda df: True)


class Chain:
    """Steps by priority, low ones first, equal ones as they were added."""

    def __init__(self, links: list[Link] | None = None):
        self.links = sorted(links or [], key=lambda x: x.priority)

    def add(self, step: Step, priority: int = 100, should_run: Callable[[DataFrame], bool] | None = None) -> Chain:
        self.links = sorted([*self.links, Link(step, priority, should_run or (lambda df: True))], key=lambda x: x.priority)
        return self

    def run(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, x: d.transform(x.step) if x.should_run(d) else d, self.links, df)

    def __or__(self, other: Chain) -> Chain:
        return Chain([*self.links, *other.links])
