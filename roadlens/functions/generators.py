"""Row-generating code as Python table functions, for lateral joins. They give the rows of the ``explode`` forms (W4's
missing steps, F27's vehicles), which stay the faster choice; a table function is the place for a generator of the user's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import physics as ph


def missing_steps(dt: float = ph.DT):
    """``(time, next time) -> (k, share)``: 0 for the row itself, then one row per step of ``dt`` missing before the next row; share
    of the way to it. No next row, or one that is a step away: the row itself alone."""

    class MissingSteps:
        def eval(self, time: float, following: float):
            yield 0, 0.0
            if time is not None and following is not None and abs(following - time - dt) > 1e-3:
                n = int(round((following - time) / dt, 3))
                for k in range(1, n):
                    yield k, k / n

    return udtf(MissingSteps, returnType="k int, share double")


def platoon_vehicles():
    """``(spec) -> (pos, kind, tags)``: a platoon text expanded to its vehicles, e.g. ``(av human*2)*3 av#sensor``."""

    class PlatoonVehicles:
        def eval(self, spec: str):
            import re

            if spec is None:
                return
            pos = 0
            for body, repeat, single in re.findall(r"\(([^)]*)\)\*(\d+)|(\S+)", spec):
                for word in (body.split() * int(repeat) if repeat else [single]):
                    name, _, times = word.partition("*")
                    kind, *tags = name.split("#")
                    for _ in range(int(times) if times else 1):
                        yield pos, kind, tags
                        pos += 1

    return udtf(PlatoonVehicles, returnType="pos int, kind string, tags array<string>")


def lateral(rows: DataFrame, table_function, *args: str | Column) -> DataFrame:
    """Each row with the rows that ``table_function`` makes of it (a row it makes nothing of goes)."""
    outer = [(F.col(a) if isinstance(a, str) else a).outer() for a in args]
    return rows.lateralJoin(table_function(*outer))
