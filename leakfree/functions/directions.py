"""Direction of metrics by name: the six standard ones and whatever is registered beside them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric name → higher is better.
METRIC_DIRECTION = {"accuracy": True, "auc": True, "logloss": False, "rmse": False,
                    "mae": False, "r2": True}

_registered: dict[str, bool] = {}


def declare(name: str, higher_is_better: bool) -> None:
    """Called for every metric that is registered, so that logs and streams know its direction."""
    _registered[name] = higher_is_better


def directions() -> dict[str, bool]:
    return {**METRIC_DIRECTION, **_registered}


def higher_is_better(metric: Column) -> Column:
    """The registry as a constant map, looked up in the row; an unknown or missing metric → higher is better."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(directions().items())])
    return F.coalesce(F.element_at(table, metric), F.lit(True))
