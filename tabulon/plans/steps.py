"""A query as ordered named steps over a source table.

Nothing runs until the resulting DataFrame is used; steps that need row positions are the exception.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

Step = Callable[[DataFrame], DataFrame]
PREVIEW_ROWS = 1000


@dataclass(frozen=True)
class Steps:
    source: "DataFrame | Steps"
    steps: tuple[tuple[str, Step], ...] = ()

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def add(self, name: str, fn: Step) -> "Steps":
        """Append a step; a taken name gets `` 1``, `` 2``, ... appended."""
        unique, n = name, 1
        while unique in self.names:
            unique, n = f"{name} {n}", n + 1
        return replace(self, steps=(*self.steps, (unique, fn)))

    def replaced(self, name: str, fn: Step) -> "Steps":
        self._at(name)
        return replace(self, steps=tuple((n, fn if n == name else f) for n, f in self.steps))

    def deleted(self, name: str) -> "Steps":
        self._at(name)
        return replace(self, steps=tuple((n, f) for n, f in self.steps if n != name))

    def renamed(self, name: str, new: str) -> "Steps":
        self._at(name)
        if new in self.names:
            raise ValueError(f"step {new!r} exists")
        return replace(self, steps=tuple((new if n == name else n, f) for n, f in self.steps))

    def upto(self, name: str) -> "Steps":
        return replace(self, steps=self.steps[: self._at(name) + 1])

    def _at(self, name: str) -> int:
        if name not in self.names:
            raise KeyError(f"no step {name!r}")
        return self.names.index(name)

    def run(self) -> DataFrame:
        df = self.source.run() if isinstance(self.source, Steps) else self.source
        for _, fn in self.steps:
            df = df.transform(fn)
        return df

    @property
    def columns(self) -> list[str]:
        return self.run().columns

    def preview(self, rows: int = PREVIEW_ROWS, order_by=None) -> DataFrame:
        df = self.run()
        return (df.orderBy(*order_by) if order_by else df).limit(rows)

    def preview_note(self, rows: int = PREVIEW_ROWS) -> str:
        total = self.run().count()
        return f"{total} rows" if total <= rows else f"{total} rows, first {rows} shown"


@dataclass(frozen=True)
class Workbook:
    """Named queries that may read each other through :meth:`run`."""

    queries: dict[str, Steps]

    def add(self, name: str, steps: Steps) -> "Workbook":
        if name in self.queries:
            raise ValueError(f"query {name!r} exists")
        return Workbook({**self.queries, name: steps})

    def deleted(self, name: str) -> "Workbook":
        return Workbook({n: q for n, q in self.queries.items() if n != name})

    def renamed(self, name: str, new: str) -> "Workbook":
        if new in self.queries:
            raise ValueError(f"query {new!r} exists")
        return Workbook({new if n == name else n: q for n, q in self.queries.items()})

    def run(self, name: str) -> DataFrame:
        return self.queries[name].run()


def column_quality(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Valid, empty and error counts per column in one pass.

    ``types`` names the type a raw column is meant to have; values that do not convert count as errors.
    """
    from tabulon.operators.transforms import change_type

    types = types or {}
    typed = df
    flags = {}
    for c, kind in types.items():
        flags[c] = f"_bad_{c}"
        typed = change_type(typed, c, kind, flag=flags[c])
    stats = []
    for c in df.columns:
        bad = F.col(flags[c]) if c in flags else F.lit(False)
        empty = F.col(c).isNull() & ~bad
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(~empty & ~bad).alias("valid"),
                F.count_if(empty).alias("empty"),
                F.count_if(bad).alias("error"),
            )
        )
    return typed.agg(F.array(*stats).alias("s")).select(F.inline("s"))
