"""Configuration from YAML; unknown keys and wrong kinds are errors."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from datetime import date
from pathlib import Path
from typing import get_type_hints


@dataclass(frozen=True)
class Split:
    """Phases by date: research before `validation`, then validation, from `holdout` on the holdout."""

    start: date = date(2005, 1, 3)
    validation: date = date(2016, 1, 1)
    holdout: date = date(2019, 1, 1)

    def __post_init__(self):
        if not self.start < self.validation < self.holdout:
            raise ValueError("phases must follow each other")

    def phase_of(self, d: date) -> str:
        return "research" if d < self.validation else "validation" if d < self.holdout else "holdout"


@dataclass(frozen=True)
class Refresh:
    overlap_days: int = 10
    retry_no_data_days: int = 30
    full_refresh_after_days: int = 365
    retries: int = 3
    restatement_tolerance: float = 1e-4


@dataclass(frozen=True)
class Config:
    source: str = "csv"
    store: str = "store"
    folder: str = "prices"
    universe: str = "static"
    tickers: list = field(default_factory=list)
    split: Split = Split()
    refresh: Refresh = Refresh()


def build(cls: type, values: dict):
    """A dataclass from a mapping, by name."""
    hints = get_type_hints(cls)
    if unknown := set(values) - {f.name for f in fields(cls)}:
        raise ValueError(f"unknown settings of {cls.__name__}: {', '.join(sorted(unknown))}")
    made = {}
    for k, v in values.items():
        kind = hints[k]
        if is_dataclass(kind):
            v = build(kind, v or {})
        elif kind is date and isinstance(v, str):
            v = date.fromisoformat(v)
        elif kind is float and isinstance(v, int):
            v = float(v)
        if not isinstance(v, kind):
            raise ValueError(f"{k} must be a {kind.__name__}")
        made[k] = v
    return cls(**made)


def load(path: str | Path) -> Config:
    import yaml

    return build(Config, yaml.safe_load(Path(path).read_text()) or {})
