"""A declared star join (R4) and a lattice of rollups over it.

``Star`` is declared once: tables, the keys that join them, dimensions and
measures. A query names what it wants, and the star joins the tables whose
columns that needs, and those on the way to them, nothing else. Joins go from
the fact outwards, many to one, and keep fact rows without a match, so a join
that is left out never changes a result.

Where all measures re-aggregate and read fact columns only, the fact is
aggregated by its own join keys before the joins: they then move one row per
key, not one per fact row.

``Lattice`` holds rollups of a star, each stored with its number of rows. A
question goes to the smallest rollup that covers it - measures, dimensions,
granularity and filters - and to the star if none does.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.metrics import COARSER, Measure, coarser
from furrow.operators.timeseries import bucket


@dataclass(frozen=True)
class Key:
    """``table.column`` refers to ``parent.parent_column``, which is unique."""

    table: str
    column: str
    parent: str
    parent_column: str


def names_in(text: str) -> set[str]:
    """Identifiers of an SQL expression, quoted strings left out."""
    return set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'(?:[^']|'')*'", " ", text)))


def _period(time: Column, granularity: str) -> Column:
    return F.year(time) if granularity == "year" else bucket(time, granularity)


@dataclass
class Star:
    fact: str
    tables: dict[str, DataFrame]
    keys: list[Key]
    measures: dict[str, Measure]
    dimensions: dict[str, str]          # name -> SQL over any table's columns
    time_dimension: str | None = None
    _home: dict[str, str] = field(init=False, repr=False)

    def __post_init__(self):
        self._home = {}
        for t, df in self.tables.items():
            for c in df.columns:
                if c in self._home:
                    raise ValueError(f"column {c} is in {self._home[c]} and in {t}; rename one")
                self._home[c] = t

    def _path(self, table: str) -> list[Key]:
        """Keys from the fact to ``table``, the fact's first (breadth first)."""
        ways, seen = {self.fact: []}, [self.fact]
        for t in seen:
            for k in self.keys:
                if k.table == t and k.parent not in ways:
                    ways[k.parent] = [*ways[t], k]
                    seen.append(k.parent)
        if table not in ways:
            raise ValueError(f"no declared key leads from {self.fact} to {table}")
        return ways[table]

    def _expand(self, text: str) -> str:
        """Dimension names in a filter become their SQL."""
        def swap(m):
            name = m.group(2)
            return m.group(1) or (f"({self.dimensions[name]})" if name in self.dimensions and self.dimensions[name] != name else name)
        return re.sub(r"('(?:[^']|'')*')|([A-Za-z_]\w*)", swap, text)

    def _used(self, texts: list[str]) -> set[str]:
        return {n for t in texts for n in names_in(t)} & set(self._home)

    def _join(self, columns: set[str], fact: DataFrame) -> DataFrame:
        path = list(dict.fromkeys(k for c in sorted(columns) for k in self._path(self._home[c])))
        out = fact
        for k in path:
            wanted = (columns | {x.column for x in path}) - {k.parent_column}
            parent = self.tables[k.parent].select(k.parent_column, *[c for c in self.tables[k.parent].columns if c in wanted])
            out = out.join(parent, out[k.column] == parent[k.parent_column], "left")
        return out

    def _keys(self, dimensions: list[str], granularity: str | None) -> list[Column]:
        out = [F.expr(self.dimensions[d]).alias(d) for d in dimensions]
        if granularity:
            out.append(_period(F.col(self.time_dimension), granularity).alias(granularity))
        return out

    def _where(self, filters, between) -> list[str]:
        out = [self._expand(f) for f in filters]
        if between:
            out.append(f"{self.time_dimension} >= TIMESTAMP_NTZ '{between[0]}' AND {self.time_dimension} < TIMESTAMP_NTZ '{between[1]}'")
        return out

    def query(self, measures: list[str], dimensions: list[str] = (), granularity: str | None = None,
              filters: list[str] = (), between: tuple | None = None, parts: bool = False) -> DataFrame:
        """``between``: [from, to) of the time dimension. ``parts``: the
        measures' re-aggregable parts in their place."""
        wanted = [self.measures[m] for m in measures]
        where = self._where(filters, between)
        outer = [self.dimensions[d] for d in dimensions] + where + ([self.time_dimension] if granularity else [])
        inner = [t for m in wanted for t in m.texts]
        fact = self.tables[self.fact]
        own = set(fact.columns)
        early = all(m.additive for m in wanted) and self._used(inner) <= own and not self._used(outer) <= own
        if early:
            path = {k.column for c in self._used(outer) for k in self._path(self._home[c])} & own
            by = sorted(path | (self._used(outer) & own))
            fact = fact.groupBy(*by).agg(*[c.alias(n) for m in wanted for n, c in m.parts()])
        joined = self._join(self._used(outer if early else outer + inner), fact)
        for w in where:
            joined = joined.where(F.expr(w))
        if parts:
            aggs = [c.alias(n) for m in wanted for n, c in (m.merged_parts() if early else m.parts())]
        else:
            aggs = [(m.reaggregate() if early else m.column()).alias(m.name) for m in wanted]
        return joined.groupBy(*self._keys(dimensions, granularity)).agg(*aggs)


@dataclass(frozen=True)
class Rollup:
    name: str
    measures: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    granularity: str | None = None

    def covers_time(self, granularity: str | None, between: tuple | None) -> bool:
        if granularity and granularity != self.granularity and granularity not in COARSER.get(self.granularity or "", set()):
            return False
        return not between or (self.granularity is not None and all(_starts(t, self.granularity) for t in between))


def _starts(when: str, granularity: str) -> bool:
    """Whether a time is the start of a bucket."""
    t = dt.datetime.fromisoformat(str(when))
    if t.minute or t.second or t.microsecond:
        return False
    whole_day = t.hour == 0
    return {"hour": True, "day": whole_day, "week": whole_day and t.weekday() == 0, "month": whole_day and t.day == 1,
            "year": whole_day and t.day == 1 and t.month == 1}[granularity]


class Lattice:
    """Rollups of ``star`` in the tables of ``store``."""

    def __init__(self, star: Star, store, rollups: list[Rollup]):
        self.star, self.store = star, store
        self.rollups = {r.name: r for r in rollups}
        self.rows: dict[str, int] = {}

    def build(self) -> "Lattice":
        """Store the rollups: the finest from the star, each other one from the
        smallest stored rollup that covers it."""
        def fineness(r):
            order = ["hour", "day", "week", "month", "year", None]
            return -len(r.dimensions), order.index(r.granularity), r.name
        for r in sorted(self.rollups.values(), key=fineness):
            source = self._smallest(r.measures, r.dimensions, r.granularity, (), None)
            if source is None:
                made = self.star.query(list(r.measures), list(r.dimensions), r.granularity, parts=True)
            else:
                made = self._from(source, r.measures, r.dimensions, r.granularity, (), None, True)
            self.store.replace(r.name, made)
            self.rows[r.name] = self.store.count(r.name)
        return self

    def _covers(self, r: Rollup, measures, dimensions, granularity, filters, between) -> bool:
        mentioned = set().union(*[names_in(f) for f in filters]) if filters else set()
        known = set(self.star.dimensions) | set(self.star._home)
        return (set(measures) <= set(r.measures) and set(dimensions) <= set(r.dimensions)
                and (mentioned & known) <= set(r.dimensions) and r.covers_time(granularity, between))

    def _smallest(self, measures, dimensions, granularity, filters, between) -> Rollup | None:
        fit = [r for r in self.rollups.values() if r.name in self.rows and self._covers(r, measures, dimensions, granularity, filters, between)]
        return min(fit, key=lambda r: (self.rows[r.name], r.name), default=None)

    def _from(self, r: Rollup, measures, dimensions, granularity, filters, between, parts: bool) -> DataFrame:
        df = self.store.read(r.name)
        for f in filters:
            df = df.where(F.expr(f))
        if between:
            start = F.col(r.granularity)
            start = F.make_date(start, F.lit(1), F.lit(1)) if r.granularity == "year" else start
            df = df.where((start >= F.lit(str(between[0])).cast("timestamp_ntz")) & (start < F.lit(str(between[1])).cast("timestamp_ntz")))
        keys = [F.col(d) for d in dimensions]
        if granularity:
            b = F.col(r.granularity)
            keys.append((b if granularity == r.granularity else coarser(b, granularity)).alias(granularity))
        wanted = [self.star.measures[m] for m in measures]
        aggs = [c.alias(n) for m in wanted for n, c in m.merged_parts()] if parts else [m.reaggregate().alias(m.name) for m in wanted]
        return df.groupBy(*keys).agg(*aggs)

    def source(self, measures, dimensions=(), granularity=None, filters=(), between=None) -> str:
        """The name of what a question is answered from."""
        r = self._smallest(measures, dimensions, granularity, filters, between)
        return r.name if r else self.star.fact

    def answer(self, measures: list[str], dimensions: list[str] = (), granularity: str | None = None,
               filters: list[str] = (), between: tuple | None = None) -> DataFrame:
        """Filters name dimensions, as in ``Star.query``."""
        r = self._smallest(measures, dimensions, granularity, filters, between)
        if r is None:
            return self.star.query(measures, dimensions, granularity, filters, between)
        return self._from(r, measures, dimensions, granularity, filters, between, False)
