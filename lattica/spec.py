"""What a query is about: region, variable, lead time, period, and their combinations. Immutable values."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce


@dataclass(frozen=True)
class Region:
    """lon: (west, east); lat: (north, south) in either order. West greater than east crosses the cut."""

    name: str
    lon: tuple[float, float]
    lat: tuple[float, float]


@dataclass(frozen=True)
class Leadtime:
    name: str
    unit: str
    value: int


@dataclass(frozen=True)
class Variable:
    name: str
    longname: str | None = None
    unit: str | None = None
    levhpa: int | None = None
    levm: int | None = None
    leadtime: Leadtime | None = None

    def __post_init__(self):
        if self.longname is None:
            object.__setattr__(self, "longname", self.name)


@dataclass(frozen=True)
class TimeRange:
    start: datetime
    end: datetime
    freq: str = "D"
    shifted: tuple[str, int] | None = None

    def __add__(self, other: TimeRange) -> TimeRange:
        """The envelope of both; a gap between them is covered too."""
        if (self.freq, self.shifted) != (other.freq, other.shifted):
            raise ValueError("periods differ in frequency or shift")
        return replace(self, start=min(self.start, other.start), end=max(self.end, other.end))


@dataclass(frozen=True)
class Selection:
    variables: tuple[Variable, ...]
    region: Region
    period: TimeRange


@dataclass(frozen=True)
class DataSource:
    name: str
    selection: Selection

    def __add__(self, other: DataSource) -> DataSource:
        a, b = self.selection, other.selection
        if a.region != b.region or a.variables != b.variables:
            raise ValueError("sources differ in region or variables")
        return DataSource(f"{self.name}+{other.name}", replace(a, period=a.period + b.period))

    def __radd__(self, other):
        return self if other == 0 else NotImplemented


def combined(sources: Iterable[DataSource]) -> DataSource:
    return reduce(lambda a, b: a + b, sources)


@dataclass(frozen=True)
class ProviderSpec:
    """A source's name and its reader options."""

    source: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Role:
    """A data set of an experiment: "input" or "target" for training or test."""

    role: str
    sources: tuple[DataSource, ...]
    params: tuple[ProviderSpec, ...] = ()
    save: bool = False


@dataclass(frozen=True)
class Experiment:
    name: str
    train: tuple[Role, ...]
    test: tuple[Role, ...]
    options: dict = field(default_factory=dict)
    #: (input, target) DataFrames -> the same, before statistics are fitted.
    hook: Callable | None = None

    def __post_init__(self):
        for part in (self.train, self.test):
            if part and {r.role for r in part} < {"input", "target"}:
                raise ValueError("both roles, input and target, are needed")
