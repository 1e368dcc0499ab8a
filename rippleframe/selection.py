"""What a question is about, and the application that answers for one repository."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

from rippleframe.engine import Engine
from rippleframe.errors import UsageError
from rippleframe.plans import report


@dataclass(frozen=True)
class Selection:
    """Either paths, or the changes against a base revision; neither stands for the current tree."""

    paths: tuple[str, ...] = ()
    base: str | None = None

    def __post_init__(self):
        if self.paths and self.base is not None:
            raise UsageError("give either paths or a base, not both")
        if self.base is not None and not self.base.strip():
            raise UsageError("the base is empty")


class Application:
    """Bound to one root. Every question builds the view anew, so it sees the files as they are."""

    def __init__(self, spark: SparkSession, root: str, index: str | None = None):
        self.spark, self.root, self.index = spark, os.path.realpath(root), index

    def engine(self) -> Engine:
        return Engine.build(self.spark, self.root, self.index)

    def impact(self, what: Selection) -> dict:
        if what.base is None and not what.paths:
            raise UsageError("no path is given")
        return self.engine().impact(list(what.paths)) if what.base is None else self.engine().git(what.base).impact()

    def plan(self, what: Selection) -> dict:
        return report.plan_dict(self.impact(what))

    def explain(self, changed: str, affected: str, what: Selection = Selection()) -> dict:
        return self.engine().why(changed, affected) if what.base is None else self.engine().git(what.base).why(changed, affected)
