"""Settings of the model: meal bands, targets, model sizes, search spaces."""

from __future__ import annotations

import random
from dataclasses import dataclass


@dataclass(frozen=True)
class Band:
    """A meal period: hours ``first`` to ``last``, both included."""

    name: str
    first: int
    last: int
    label: str = ""


# fixed values: meal periods and the model settings that go with them
MEAL_BANDS = (
    Band("lunch", 11, 14, "午餐 Lunch (11-14h)"),
    Band("afternoon", 15, 17, "下午茶 Afternoon (15-17h)"),
    Band("dinner", 18, 23, "晚餐 Dinner (18-23h)"),
)
TWO_BANDS = (Band("lunch2", 9, 14), Band("dinner2", 15, 23))
OVERLAPPING_BANDS = (Band("lunch", 10, 14), Band("afternoon", 14, 17), Band("dinner", 17, 23))
GRANULARITY = {
    "hour": ("reservation_hour", ("reservation_seconds", "reservation_half_hour")),
    "half_hour": ("reservation_half_hour", ("reservation_hour", "reservation_seconds")),
}
ROUTING_COLUMN = "reservation_hour"


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 200
    depth: int = 6
    learning_rate: float = 0.1
    min_leaf: int = 1
    seed: int = 42


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 200
    depth: int = 15
    min_leaf: int = 5
    seed: int = 42


@dataclass(frozen=True)
class EvaluationSettings:
    test_size: float = 0.2
    split: str = "random"
    folds: int = 5
    tolerance: int = 1


@dataclass(frozen=True)
class Choice:
    """One of some values."""

    options: tuple

    def draw(self, rng: random.Random):
        return rng.choice(self.options)


@dataclass(frozen=True)
class Whole:
    """A whole number, both ends included."""

    low: int
    high: int

    def draw(self, rng: random.Random) -> int:
        return rng.randint(self.low, self.high)


@dataclass(frozen=True)
class Real:
    """A number, even in its logarithm if ``log``."""

    low: float
    high: float
    log: bool = False

    def draw(self, rng: random.Random) -> float:
        at = rng.random()
        return self.low * (self.high / self.low) ** at if self.log else self.low + (self.high - self.low) * at


Range = Choice | Whole | Real

# fixed values: the ranges that the models are searched in
BOOST_SEARCH_SPACE = {
    "rounds": Choice((100, 300, 500, 1000)), "depth": Whole(3, 12), "learning_rate": Real(0.01, 0.3, log=True),
    "min_leaf": Whole(1, 10),
}
FOREST_SEARCH_SPACE = {"trees": Choice((100, 200, 300, 500)), "depth": Whole(4, 20), "min_leaf": Whole(2, 20)}


def resolve_granularity(name: str) -> tuple[str, tuple[str, ...]]:
    """Target column and the columns that would leak it."""
    return GRANULARITY[name]


def check_routable(bands) -> None:
    """Routing needs bands that do not share an hour."""
    taken: dict[int, str] = {}
    for band in bands:
        for hour in range(band.first, band.last + 1):
            if hour in taken:
                raise ValueError(f"bands {taken[hour]!r} and {band.name!r} both hold hour {hour}")
            taken[hour] = band.name
