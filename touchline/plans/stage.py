"""Stages with a typed column contract, chained over (detections, frames)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from operator import attrgetter

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class ContractError(ValueError):
    """A column is missing or has another type than declared."""


def check(df: DataFrame, columns: dict[str, T.DataType], where: str) -> None:
    have = {f.name: f.dataType for f in df.schema.fields}
    for name, kind in columns.items():
        if name not in have:
            raise ContractError(f"{where}: column {name!r} is missing")
        if have[name].simpleString() != kind.simpleString():
            raise ContractError(f"{where}: column {name!r} is {have[name].simpleString()}, not {kind.simpleString()}")


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[DataFrame, DataFrame], DataFrame]
    inputs: dict[str, T.DataType] = field(default_factory=dict)
    outputs: dict[str, T.DataType] = field(default_factory=dict)
    enabled: bool = True


def validate(stages: list[Stage], columns: dict[str, T.DataType]) -> None:
    """Every enabled stage's inputs are columns of the source or outputs of an earlier enabled stage."""
    have = dict(columns)
    for s in filter(attrgetter("enabled"), stages):
        for name, kind in s.inputs.items():
            if name not in have:
                raise ContractError(f"{s.name}: nothing before it makes {name!r}")
            if have[name].simpleString() != kind.simpleString():
                raise ContractError(f"{s.name}: {name!r} is {have[name].simpleString()}, not {kind.simpleString()}")
        have |= s.outputs


def compose(stages: list[Stage], detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Runs the enabled stages in order; plans only, nothing is computed."""
    validate(stages, {f.name: f.dataType for f in detections.schema.fields})
    for s in filter(attrgetter("enabled"), stages):
        check(detections, s.inputs, s.name)
        detections = s.run(detections, frames)
        check(detections, s.outputs, s.name)
    return detections
