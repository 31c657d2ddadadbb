"""Ordered state machines: positions of a pair, states of a book. One group is one pair or ticker, as long as the calendar at most."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PairRule:
    """Thresholds on the score, and the longest holding time in sessions."""

    entry: float = 1.5
    exit: float = 0.5
    stop: float = 3.0
    max_hold: int = 10

    def __post_init__(self):
        if not (0 <= self.exit < self.entry < self.stop and self.max_hold >= 1):
            raise ValueError("needs 0 <= exit < entry < stop and max_hold >= 1")


MEAN, STOP, TIME, DATA = 1, 2, 3, 4


@dataclass
class PairMachine:
    """The state of a pair between sessions; step() takes a score and gives the position and why one was closed (0: none was)."""

    rule: PairRule
    position: int = 0
    held: int = 0
    barred_long: bool = False
    barred_short: bool = False

    def step(self, z: float | None) -> tuple[int, int]:
        """A null or NaN score closes a position and lifts no bar."""
        rule, why = self.rule, 0
        if z is None or math.isnan(z):
            why, self.position = (DATA, 0) if self.position else (0, 0)
            return 0, why
        if abs(z) <= rule.exit:
            self.barred_long = self.barred_short = False
        if self.position:
            self.held, loss = self.held + 1, -self.position * z
            why = STOP if loss >= rule.stop else MEAN if loss <= rule.exit else TIME if self.held >= rule.max_hold else 0
            if why in (STOP, TIME):
                self.barred_long |= self.position > 0
                self.barred_short |= self.position < 0
            self.position = 0 if why else self.position
        else:
            side = -1 if z > 0 else 1
            if rule.entry < abs(z) < rule.stop and not (self.barred_long if side > 0 else self.barred_short):
                self.position, self.held = side, 0
        return self.position, why


def walk_pair(scores: list[float | None], rule: PairRule, start: int = 0) -> tuple[list[int], list[int]]:
    """Positions and exit reasons along a score series; nothing happens before `start`."""
    machine = PairMachine(rule)
    steps = [(0, 0)] * min(start, len(scores)) + [machine.step(z) for z in scores[start:]]
    return [p for p, _ in steps], [why for _, why in steps]


def walk_book(scores: list[float | None], entry: float, exit: float, stop: float, max_hold: int) -> list[int]:
    """States along a score series: strict exits, one bar for both sides, a flip within a session, the last row flat.

    A missing score counts as 0: it closes, and lifts the bar if exit is above 0.
    """
    state, held, barred, out = 0, 0, False, []
    for z in scores:
        missing = z is None or math.isnan(z)
        z, forced = 0.0 if missing else z, False
        if state:
            held, loss = held + 1, -state * z
            late = loss > stop or held >= max_hold
            if missing or late or loss < exit:
                state, forced = 0, late and not missing
        barred = (barred or forced) and not abs(z) < exit
        if not (state or missing or barred) and entry < abs(z) < stop:
            state, held = (-1 if z > 0 else 1), 0
        out.append(state)
    return [*out[:-1], 0]


def pair_positions(scores: DataFrame, rule: PairRule = PairRule()) -> DataFrame:
    """scores (y, x, d, i, ry, rx, beta, z) with pos and reason of the pair rule; i orders a pair's rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        pdf["pos"], pdf["reason"] = walk_pair(pdf["z"].tolist(), rule)
        return pdf

    schema = "y string, x string, d date, i int, ry double, rx double, beta double, z double, pos int, reason int"
    return scores.select("y", "x", "d", "i", "ry", "rx", "beta", "z").groupBy("y", "x").applyInPandas(one, schema)


def score_states(scores: DataFrame, entry: float = 1.25, exit: float = 0.5, stop: float = 4.0, max_hold: int = 60) -> DataFrame:
    """scores (ticker, d, i, z) with the book's state of each row."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        pdf["state"] = walk_book(pdf["z"].tolist(), entry, exit, stop, max_hold)
        return pdf

    return scores.select("ticker", "d", "i", "z").groupBy("ticker").applyInPandas(one, "ticker string, d date, i int, z double, state int")
