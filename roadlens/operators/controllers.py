"""Named controllers over logged rows, with plug-ins.

A controller turns the logged state of a row into an acceleration. Built-in ones are Column builders and stay in
the JVM; a plug-in is a function on pandas Series, run as one Arrow batch after the other. ``accelerations`` evaluates
rows of any mix of controllers in a single pass: no grouping by controller, so nothing depends on
how many rows one of them has.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics as ph

STATE = ("speed", "leader_speed", "headway")


class ControllerRegistry:
    """Names -> controllers. ``builder(*state columns) -> Column``, or a plug-in on pandas Series."""

    def __init__(self, state: tuple[str, ...] = STATE):
        self.state = state
        self._builders: dict[str, Callable[..., Column]] = {}
        self._plugins: dict[str, tuple[Callable, dict]] = {}

    def names(self) -> list[str]:
        return sorted([*self._builders, *self._plugins])

    def _new(self, name: str) -> None:
        if not name or name in self._builders or name in self._plugins:
            raise ValueError(f"controller name {name!r} is empty or taken")

    def register(self, name: str, builder: Callable[..., Column]) -> "ControllerRegistry":
        self._new(name)
        self._builders[name] = builder
        return self

    def plug_in(self, name: str, fn: Callable, **params) -> "ControllerRegistry":
        """``fn(*state Series, **params) -> Series`` of doubles. It sees rows of its own only; their order and number say nothing."""
        self._new(name)
        self._plugins[name] = (fn, params)
        return self

    def _plugged(self, name: str, mine: Column) -> Column:
        fn, params = self._plugins[name]

        @F.pandas_udf("double")
        def run(own: pd.Series, state: pd.DataFrame) -> pd.Series:
            out = pd.Series(float("nan"), index=own.index, dtype=float)
            if own.any():
                part = state[own]
                out[own] = pd.Series(fn(*(part[c] for c in part.columns), **params)).to_numpy(float)
            return out

        return run(mine, F.struct(*self.state))

    def accelerations(self, rows: DataFrame, controller: str | Column, name: str = "accel") -> DataFrame:
        """``rows`` with ``name``: the acceleration that each row's controller gives. A null controller gives null, a
        name that is not registered fails the query and says which it is."""
        who = F.col(controller) if isinstance(controller, str) else controller
        cols = [F.col(c) for c in self.state]
        out = F.when(who.isNull(), F.lit(None).cast("double"))
        for key, builder in self._builders.items():
            out = out.when(who == key, builder(*cols))
        for key in self._plugins:
            out = out.when(who == key, self._plugged(key, F.coalesce(who == key, F.lit(False))))
        unknown = F.raise_error(F.concat(F.lit("unknown controller: "), who.cast("string"), F.lit("; known: " + ", ".join(self.names()))))
        return rows.withColumn(name, out.otherwise(unknown.cast("double")))


def builtin() -> ControllerRegistry:
    """The intelligent driver model and the follower-stopper."""
    return ControllerRegistry().register("idm", ph.idm_accel).register("fs", ph.follower_stopper_accel)


def constant_time_gap(speed, leader_speed, headway, time_gap: float = 1.4, standstill: float = 5.0, k_gap: float = 0.23, k_speed: float = 0.07):
    """A plug-in: linear law of the gap's and the speed's error, within the follower-stopper's limits."""
    want = k_gap * (headway - standstill - time_gap * speed) + k_speed * (leader_speed - speed)
    return want.clip(-3.0, 1.5)
