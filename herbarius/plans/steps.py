"""Running named steps in order, each of which makes a table; finished ones can be kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.landed import save


@dataclass
class Step:
    """``make`` gets the tables made so far by name and returns the step's table."""

    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    optional: bool = False


@dataclass
class Flow:
    """Steps in order.  ``run`` skips steps whose table exists unless ``force`` is set; an
    optional step that fails is noted and left out, any other failure ends the run."""

    steps: list[Step]
    failed: dict[str, str] = field(default_factory=dict)

    def run(self, spark: SparkSession, only: list[str] | None = None, skip: list[str] = (), force: bool = False) -> dict[str, DataFrame]:
        names = [s.name for s in self.steps]
        if unknown := (set(only or ()) | set(skip)) - set(names):
            raise ValueError(f"no such steps: {sorted(unknown)}")
        made: dict[str, DataFrame] = {}
        for step in self.steps:
            chosen = (only is None or step.name in only) and step.name not in skip
            there = spark.catalog.tableExists(step.name)
            if chosen and (force or not there):
                try:
                    save(step.make(made), step.name)
                except Exception as e:
                    if not step.optional:
                        raise
                    self.failed[step.name] = str(e)
                    continue
            elif not there:
                continue
            made[step.name] = spark.table(step.name)
        return made
