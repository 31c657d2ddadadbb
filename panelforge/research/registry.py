"""A registry of trials, a holdout that opens once, and reports of saved results; small files on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import re
from datetime import date, datetime, timezone
from pathlib import Path

from panelforge.functions.sharpe import money


def spec_id(spec: dict) -> str:
    """12 hex digits of a specification, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:12]


class Registry:
    """Trials as JSON lines, appended and never changed."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def append(self, family: str, spec: dict, result: dict | None = None, phase: str = "research") -> str:
        row = {"at": datetime.now(timezone.utc).isoformat(), "id": spec_id(spec), "family": family, "phase": phase, "spec": spec, "result": result or {}}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as f:
            f.write(json.dumps(row, sort_keys=True, default=str) + "\n")
        return row["id"]

    def scan(self, family: str | None = None) -> list[dict]:
        if not self.path.exists():
            return []
        rows = [json.loads(line) for line in self.path.read_text().splitlines() if line.strip()]
        return [r for r in rows if family in (None, r["family"])]

    def count_trials(self, family: str | None = None) -> int:
        """Distinct specifications: a repeated run is one trial."""
        return len({r["id"] for r in self.scan(family)})

    def markdown(self) -> str:
        head = "| family | trial | phase | result |\n|---|---|---|---|\n"
        newest = {(r["family"], r["id"]): r for r in self.scan()}
        return head + "".join(f"| {f} | {i} | {r['phase']} | {', '.join(f'{k} {v}' for k, v in sorted(r['result'].items()))} |\n" for (f, i), r in sorted(newest.items()))


class HoldoutError(RuntimeError):
    """The holdout was read while locked, or unlocked twice."""


class Holdout:
    """Guards dates from `start` on, until a recorded unlock."""

    def __init__(self, ledger: str | Path, start: date):
        self.ledger, self.start, self.open = Path(ledger), start, False

    def entries(self) -> list[dict]:
        return [json.loads(x) for x in self.ledger.read_text().splitlines()] if self.ledger.exists() else []

    def unlock(self, reason: str, allow_reopen: bool = False) -> None:
        if not reason.strip():
            raise HoldoutError("an unlock needs a reason")
        if self.entries() and not allow_reopen:
            raise HoldoutError("the holdout was unlocked before")
        self.ledger.parent.mkdir(parents=True, exist_ok=True)
        with self.ledger.open("a") as f:
            f.write(json.dumps({"at": datetime.now(timezone.utc).isoformat(), "reason": reason, "reopened": allow_reopen}) + "\n")
        self.open = True

    def check(self, end: date, as_of: date | None = None) -> None:
        if not self.open and max(end, as_of or end) >= self.start:
            raise HoldoutError(f"dates from {self.start} on are held out")


def load_results(folder: str | Path, names: list[str]) -> dict[str, dict]:
    """Saved results by name; a missing one is an error."""
    return {n: json.loads((Path(folder) / f"{n}.json").read_text()) for n in names}


def headline_numbers(results: dict, prefix: str = "") -> dict[str, float | int | str]:
    """Every number and text of nested results under a dotted name."""
    out: dict = {}
    for k, v in results.items() if isinstance(results, dict) else enumerate(results):
        name = f"{prefix}.{k}" if prefix else str(k)
        out |= headline_numbers(v, name) if isinstance(v, (dict, list)) else {name: v}
    return out


def render(template: str, numbers: dict) -> str:
    """{{name}} and {{name|format}} replaced; money is a format; an unknown name is an error."""

    def one(m: re.Match) -> str:
        name, form = m[1].strip(), (m[2] or "").strip()
        if name not in numbers:
            raise KeyError(f"no number {name}")
        return money(numbers[name]) if form == "money" else format(numbers[name], form)

    return re.sub(r"\{\{([^}|]+)(?:\|([^}]*))?\}\}", one, template)


def write_atomic(path: str | Path, text: str) -> None:
    """Replace a small file in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(path.suffix + ".new")
    new.write_text(text)
    os.replace(new, path)
