"""Predicates that the sources take over from Spark."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual


class Pushed:
    """Allowed values of text columns and closed ranges of whole-number columns, narrowed filter by filter."""

    def __init__(self, texts: Iterable[str], numbers: Iterable[str]):
        self.texts: dict[str, set[str] | None] = dict.fromkeys(texts)
        self.ranges: dict[str, list] = {n: [float("-inf"), float("inf")] for n in numbers}

    def take(self, f: Filter) -> bool:
        """Whether the filter is now applied by the source."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, IsNotNull):
            return name in self.texts or name in self.ranges  # these columns are never null
        if name in self.texts and isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            known = self.texts[name]
            self.texts[name] = values if known is None else known & values
            return True
        if name in self.ranges and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            low, high = self.ranges[name]
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                low = max(low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                high = min(high, f.value - isinstance(f, LessThan))
            self.ranges[name] = [low, high]
            return True
        return False

    def allows(self, **values) -> bool:
        for name, value in values.items():
            if name in self.texts:
                if self.texts[name] is not None and value not in self.texts[name]:
                    return False
            elif not self.ranges[name][0] <= value <= self.ranges[name][1]:
                return False
        return True


def pushdown(spark: SparkSession) -> str:
    """Whether the session hands predicates to Python sources. If not, Spark refuses a reader that would take them."""
    return spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()


def takes_filters(options: dict) -> bool:
    return options.get("pushdown", "false").lower() == "true"
