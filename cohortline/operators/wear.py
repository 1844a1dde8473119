"""The road-wear index: a coefficient by axles or vehicle type times the fourth power of the mass."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The share of the mass on each axle, in percent; the last number of axles also stands for more.
BY_AXLES = {2: (45.0, 55.0), 3: (30.0, 35.0, 35.0), 4: (25.0, 25.0, 25.0, 25.0), 5: (20.0, 20.0, 20.0, 20.0, 20.0), 6: (16.67, 16.67, 16.67, 16.67, 16.67, 16.66)}
BY_TYPE = {"CA": (30.0, 35.0, 35.0), "VO": (30.0, 35.0, 35.0), "AB": (35.0, 65.0), "AU": (50.0, 50.0), "*": (50.0, 50.0)}


def coefficient(weights: tuple[float, ...]) -> float:
    """Sum of the fourth powers of the axles' shares."""
    return sum((w / 100) ** 4 for w in weights)


def coefficient_of(weights: Column) -> Column:
    return F.aggregate(F.transform(weights, lambda w: F.pow(w / 100, F.lit(4))), F.lit(0.0), lambda a, x: a + x)


def valid(weights: tuple[float, ...]) -> bool:
    """Shares are over 0, at most 100 each, and make 100."""
    return bool(weights) and all(0 < w <= 100 for w in weights) and abs(sum(weights) - 100) <= 0.01 + 1e-9


@dataclass(frozen=True)
class Wear:
    """A configuration: shares by number of axles, and by vehicle type where no number matches."""

    by_axles: tuple[tuple[int, tuple[float, ...]], ...] = field(default=tuple(BY_AXLES.items()))
    by_type: tuple[tuple[str, tuple[float, ...]], ...] = field(default=tuple(BY_TYPE.items()))

    def __post_init__(self) -> None:
        for key, weights in (*self.by_axles, *self.by_type):
            if not valid(weights):
                raise ValueError(f"the shares of {key} do not make 100")

    def to_json(self) -> str:
        return json.dumps({"by_axles": {str(k): list(w) for k, w in self.by_axles}, "by_type": {k: list(w) for k, w in self.by_type}}, indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Wear:
        """A saved configuration; its shares are checked, and coefficients are computed from them."""
        said = json.loads(text)
        return cls(tuple((int(k), tuple(w)) for k, w in said["by_axles"].items()), tuple((k, tuple(w)) for k, w in said["by_type"].items()))

    def coefficient(self) -> Column:
        most = max(k for k, _ in self.by_axles)
        arms = [(F.col("max_axles") >= k if k == most else F.col("max_axles") == k, coefficient(w)) for k, w in sorted(self.by_axles)]
        arms += [(F.col("vehicle_type") == k, coefficient(w)) for k, w in sorted(self.by_type) if k != "*"]
        rest = F.lit(coefficient(dict(self.by_type)["*"]))
        return reduce(lambda out, arm: F.when(arm[0], F.lit(arm[1])).otherwise(out), reversed(arms), rest)

    def index(self) -> Column:
        return self.coefficient() * F.pow(F.col("net_mass"), F.lit(4.0))
