"""Schedule arithmetic on epoch seconds: cadence boundaries, deterministic jitter, recovery after missed runs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of an interval in seconds: a minute to 366 days.
LEAST, MOST = 60, 366 * 86_400
DAY = 86_400

# The domain of the jitter, then the step and the two multipliers of splitmix64.
JITTER_DOMAIN = 0x57534A4954544552
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@dataclass(frozen=True)
class Cadence:
    """Every ``period`` seconds, ``shift`` seconds after the epoch's grid; no period means manual runs only."""

    period: int | None
    shift: int = 0

    @staticmethod
    def interval(seconds: int) -> Cadence:
        """A grid from the epoch."""
        if not LEAST <= seconds <= MOST:
            raise ValueError("interval out of bounds")
        return Cadence(seconds)

    @staticmethod
    def daily(seconds_after_midnight: int) -> Cadence:
        """Once in a UTC day."""
        if not 0 <= seconds_after_midnight < DAY:
            raise ValueError("time of day out of bounds")
        return Cadence(DAY, seconds_after_midnight)

    @staticmethod
    def manual() -> Cadence:
        """Never by itself."""
        return Cadence(None)


def next_nominal(cadence: Cadence, after: Column) -> Column:
    """The first boundary later than ``after``; null for manual runs."""
    if cadence.period is None:
        return F.lit(None).cast("long")
    since = F.pmod(after - F.lit(cadence.shift), F.lit(cadence.period))
    return (after - since + F.lit(cadence.period)).cast("long")


def jitter(ident: Column, nominal: Column, most: int) -> Column:
    """Seconds in [0, ``most``], always the same for a schedule and its nominal time."""
    if most <= 0:
        return F.when(ident.isNotNull() & nominal.isNotNull(), F.lit(0).cast("long"))

    def mix(v: np.ndarray) -> np.ndarray:
        v = v + np.uint64(STEP)
        for right, times in ((30, FIRST), (27, SECOND)):
            v = (v ^ (v >> np.uint64(right))) * np.uint64(times)
        return v ^ (v >> np.uint64(31))

    @F.pandas_udf("long")
    def run(idents: pd.Series, times: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            i, t = (s.to_numpy(np.int64).view(np.uint64) for s in (idents, times))
            turned = (t << np.uint64(29)) | (t >> np.uint64(35))
            mixed = mix(np.uint64(JITTER_DOMAIN) ^ mix(i) ^ mix(turned))
            return pd.Series((mixed % np.uint64(most + 1)).astype(np.int64))

    zero = F.lit(0).cast("long")
    value = run(F.coalesce(ident.cast("long"), zero), F.coalesce(nominal.cast("long"), zero))
    return F.when(ident.isNotNull() & nominal.isNotNull(), value)


def next_occurrence(cadence: Cadence, ident: Column, spread: int, after: Column) -> Column:
    """The earliest jittered occurrence later than ``after``.

    The jitter is shorter than the period, so only the first boundary of the
    window that it spans and the one behind it can be that occurrence.
    """
    if cadence.period is None:
        return F.lit(None).cast("long")
    most = min(spread, cadence.period - 1)
    first = next_nominal(cadence, F.greatest(after - F.lit(most), F.lit(0)) - 1)
    second = first + F.lit(cadence.period)
    early, late = (n + jitter(ident, n, most) for n in (first, second))
    return F.when(early > after, early).otherwise(late)


def recover(cadence: Cadence, ident: Column, spread: int, persisted: Column, now: Column) -> tuple[Column, Column]:
    """(due_at, next_run_at): at most one run is due, whatever else was missed is skipped."""
    if cadence.period is None:
        return F.lit(None).cast("long"), F.lit(None).cast("long")
    due = persisted <= now
    return F.when(due, persisted), F.when(persisted.isNotNull() & ~due, persisted).otherwise(next_occurrence(cadence, ident, spread, now))
