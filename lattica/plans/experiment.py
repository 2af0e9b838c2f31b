"""An experiment from declaration to verification: roles are aligned, a correction is fitted, applied and verified."""

from __future__ import annotations

import itertools
import json
import tomllib
from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import align, stats, verify
from lattica.registry import EXPERIMENTS, LAUNCHERS, LOSSES
from lattica.spec import Experiment, Role


def combinations(config: dict) -> list[dict]:
    """Every choice of one value from each list, nested tables included, in order."""
    choices = [[(k, v) for v in (combinations(x) if isinstance(x, dict) else x if isinstance(x, list) else [x])] for k, x in config.items()]
    return [dict(c) for c in itertools.product(*choices)]


def load_runs(path: str) -> list[dict]:
    with open(path, "rb") as f:
        return combinations(tomllib.load(f))


def name_of(variables: list[str], lead: str, region: str, start: str, end: str, providers: list[str]) -> str:
    return "_".join(["-".join(variables), lead, region, f"{start}-{end}", *providers])


def manifest(experiment: Experiment, paths: dict[str, str]) -> str:
    """JSON of the options and of where each data set is stored."""
    return json.dumps({"name": experiment.name, "options": experiment.options, "paths": paths}, sort_keys=True, default=str)


LOSSES.register("mse")(lambda p, y: F.avg((p - y) * (p - y)))
LOSSES.register("mae")(lambda p, y: F.avg(F.abs(p - y)))
LOSSES.register("rmse")(lambda p, y: F.sqrt(F.avg((p - y) * (p - y))))


def pair(inputs: DataFrame, target: DataFrame, input_name: str, target_name: str, missed: list[DataFrame], hook=None) -> DataFrame:
    """(t, y, x, b, a): a forecast b beside its truth a, without the dates that any role misses; members share one truth."""
    if hook:
        inputs, target = hook(inputs, target)
    if missed:
        gone = align.missing_anywhere(missed)
        inputs, target = align.without(inputs, gone), align.without(target, gone)
    keys = [k for k in ("t", "y", "x") if k in inputs.columns and k in target.columns]
    return inputs.withColumnRenamed(input_name, "b").join(target.select(*keys, F.col(target_name).alias("a")), keys)


class Scenario(Protocol):
    """What a launcher asks of a domain: its variables, and the roles of training and test for a configuration."""

    variables: tuple[str, ...]

    def train(self, config: dict) -> tuple[Role, ...]: ...

    def test(self, config: dict) -> tuple[Role, ...]: ...


def transformed(df: DataFrame, make: Callable[[Column, Column], tuple[Column, Column]], x: str = "b", y: str = "a") -> DataFrame:
    """Inputs and targets through a transform of both, as column expressions, before a correction is fitted."""
    new_x, new_y = make(F.col(x), F.col(y))
    return df.withColumns({x: new_x, y: new_y})


@EXPERIMENTS.register("forecast-correction")
def run(train: DataFrame, test: DataFrame, by: list[str], names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Corrected test rows (column p), and metrics of the raw (model "raw") and corrected ("corrected") forecasts per cell."""
    out = stats.apply_linear(test, stats.fit_linear(train, by), by)
    models = verify.pair_models(out, "a", {"raw": "b", "corrected": "p"}, by)
    return out, verify.cell_metrics(models, ["model", *by], names or verify.METRICS)


def loss(name: str, df: DataFrame, p: str = "p", y: str = "a") -> float:
    return df.agg(LOSSES[name](F.col(p), F.col(y))).first()[0]


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Variables of another archive by an explicit map; a name that is not there is an error."""
    if lacking := sorted(set(names) - set(df.columns)):
        raise KeyError(f"no such variables: {', '.join(lacking)}")
    return df.withColumnsRenamed(names)


def _states(parts: list[DataFrame], keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Per cell the least and greatest value (`_lo_v`, `_hi_v`) of each variable over all parts: one aggregation over a union, however many parts."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in union.columns if c not in keys]
    return union.groupBy(*keys).agg(*[f(c).alias(f"{to}{c}") for c in names for f, to in ((F.min, "_lo_"), (F.max, "_hi_"))]), names


def combine_variables(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per cell with the variables of all parts, nulls filled from whichever part has a value; raises when read if two values of one cell
    differ, be they of two parts or of a part's repeated rows. Null keys are equal to each other."""
    cells, names = _states(parts, keys)
    clash = {c: F.raise_error(F.concat(F.lit(f"conflicting values of {c} at "), F.to_json(F.struct(*keys)))) for c in names}
    kinds = {c.removeprefix("_lo_"): kind for c, kind in cells.dtypes}
    return cells.select(*keys, *[F.when(F.col(f"_lo_{c}") != F.col(f"_hi_{c}"), clash[c].cast(kinds[c])).otherwise(F.col(f"_lo_{c}")).alias(c) for c in names])


def conflicts(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, variable, low, high) of the cells at which combine_variables would raise, for numeric variables."""
    cells, names = _states(parts, keys)
    found = F.array(*[F.when(F.col(f"_lo_{c}") != F.col(f"_hi_{c}"), F.struct(F.lit(c).alias("variable"), F.col(f"_lo_{c}").cast("double").alias("low"), F.col(f"_hi_{c}").cast("double").alias("high"))) for c in names])
    return cells.select(*keys, F.explode(F.array_compact(found)).alias("c")).select(*keys, "c.variable", "c.low", "c.high")


@LAUNCHERS.register("grid-search")
def launch(config: dict, data: Callable[[dict], tuple[DataFrame, DataFrame]], experiment: str = "forecast-correction", by: tuple[str, ...] = ("y", "x")) -> list[tuple[dict, DataFrame]]:
    """Every choice of a configuration with the metrics of its experiment. data: a choice -> (train, test). Nothing runs until metrics are read."""
    return [(choice, EXPERIMENTS[experiment](*data(choice), list(by))[1]) for choice in combinations(config)]
