"""Semantic-layer queries (R4): declared measures x dimensions over a star join,
plus pre-aggregations that coarser queries reuse.

A ``Cube`` names a fact DataFrame (already joined to its dimensions by the
caller's ``source`` function), its measures and its dimensions. A query picks
measures, dimensions, an optional time granularity and filters; the plan is a
``where`` -> ``groupBy`` -> ``agg`` that Catalyst prunes and pushes down.

Re-aggregation: additive measures (``sum``, ``count``), ``min`` and ``max`` can
be answered from a pre-aggregate; ``avg`` is answered as sum / count from its
parts and ``ratio`` (sum of one expression over the sum of another) likewise.
``count_distinct`` is never re-aggregated (it raises instead of being wrong);
``approx_distinct`` and ``approx_quantile`` keep sketches, which coarser
queries merge. A merged sketch is as good as one built from the rows: with
``HLL_LOG`` = 14 the relative standard error of a distinct count is 0.8 %, with
``KLL_K`` = 800 a quantile's rank is off by about 0.4 % of the rows at most.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.timeseries import bucket

HLL_LOG, KLL_K = 14, 800


@dataclass(frozen=True)
class Measure:
    name: str
    kind: str                  # one of KINDS
    expr: str | tuple | None = None   # SQL over the fact; ratio: (numerator, denominator); approx_quantile: (value, share)

    KINDS = ("sum", "count", "count_distinct", "avg", "ratio", "min", "max", "approx_distinct", "approx_quantile")

    def __post_init__(self):
        if self.kind not in self.KINDS:
            raise ValueError(f"measure {self.name}: no kind {self.kind!r}")

    @property
    def additive(self) -> bool:
        return self.kind != "count_distinct"

    @property
    def texts(self) -> list[str]:
        """The SQL that the measure reads."""
        parts = self.expr if isinstance(self.expr, tuple) else (self.expr,)
        return [p for p in parts if isinstance(p, str)]

    def _sketch(self) -> Column:
        if self.kind == "approx_distinct":
            return F.hll_sketch_agg(F.expr(self.expr), F.lit(HLL_LOG))
        return F.kll_sketch_agg_double(F.expr(self.expr[0]).cast("double"), F.lit(KLL_K))

    def _estimate(self, sketch: Column) -> Column:
        if self.kind == "approx_distinct":
            return F.hll_sketch_estimate(sketch)
        return F.kll_sketch_get_quantile_double(sketch, F.lit(float(self.expr[1])))

    def _ratio(self, num: Column, den: Column) -> Column:
        return num.cast("double") / den.cast("double")

    def column(self) -> Column:
        if self.kind == "ratio":
            n, d = self.expr
            return self._ratio(F.sum(F.expr(n)), F.sum(F.expr(d)))
        if self.kind.startswith("approx_"):
            return self._estimate(self._sketch())
        e = F.expr(self.expr) if self.expr else F.lit(1)
        return {"sum": F.sum, "count": F.count, "count_distinct": F.count_distinct, "avg": F.avg, "min": F.min, "max": F.max}[self.kind](e)

    def parts(self) -> list[tuple[str, Column]]:
        """Additive partial columns kept in a pre-aggregate."""
        if self.kind == "ratio":
            n, d = self.expr
            return [(f"{self.name}__num", F.sum(F.expr(n))), (f"{self.name}__den", F.sum(F.expr(d)))]
        if self.kind.startswith("approx_"):
            return [(f"{self.name}__sketch", self._sketch())]
        e = F.expr(self.expr) if self.expr else F.lit(1)
        if self.kind in ("sum", "count", "min", "max"):
            return [(self.name, self.column())]
        if self.kind == "avg":
            return [(f"{self.name}__sum", F.sum(e)), (f"{self.name}__n", F.count(e))]
        raise ValueError(f"measure {self.name} ({self.kind}) cannot be pre-aggregated")

    def merged_parts(self) -> list[tuple[str, Column]]:
        """The parts of a coarser pre-aggregate, from those of a finer one."""
        if self.kind in ("min", "max"):
            return [(self.name, self.reaggregate())]
        if self.kind.startswith("approx_"):
            merge = F.hll_union_agg if self.kind == "approx_distinct" else F.kll_merge_agg_double
            return [(f"{self.name}__sketch", merge(f"{self.name}__sketch"))]
        return [(n, F.sum(n)) for n, _ in self.parts()]

    def reaggregate(self) -> Column:
        if self.kind in ("sum", "count"):
            return F.sum(self.name)
        if self.kind in ("min", "max"):
            return getattr(F, self.kind)(self.name)
        if self.kind == "approx_distinct":
            return self._estimate(F.hll_union_agg(f"{self.name}__sketch"))
        if self.kind == "approx_quantile":
            return self._estimate(F.kll_merge_agg_double(f"{self.name}__sketch"))
        if self.kind == "avg":
            return F.sum(f"{self.name}__sum") / F.sum(f"{self.name}__n")
        if self.kind == "ratio":
            return self._ratio(F.sum(f"{self.name}__num"), F.sum(f"{self.name}__den"))
        raise ValueError(f"measure {self.name} ({self.kind}) is not re-aggregable")


@dataclass
class Cube:
    fact: DataFrame
    measures: dict[str, Measure]
    dimensions: dict[str, str] = field(default_factory=dict)   # name -> SQL expression
    time_dimension: str | None = None

    def _dims(self, names: list[str], granularity: str | None) -> list[Column]:
        cols = [F.expr(self.dimensions.get(n, n)).alias(n) for n in names]
        if granularity:
            cols.append(bucket(F.col(self.time_dimension), granularity).alias(granularity))
        return cols

    def query(self, measures: list[str], dimensions: list[str], granularity: str | None = None,
              filters: list[str] = ()) -> DataFrame:
        df = self.fact
        for f in filters:
            df = df.where(F.expr(f))
        return df.groupBy(*self._dims(dimensions, granularity)).agg(
            *[self.measures[m].column().alias(m) for m in measures])

    def rollup(self, measures: list[str], dimensions: list[str]) -> DataFrame:
        """Subtotals along the dimension list, with ``grouping_id``."""
        return self.fact.rollup(*self._dims(dimensions, None)).agg(
            *[self.measures[m].column().alias(m) for m in measures],
            F.grouping_id().cast("bigint").alias("gid"))

    def preaggregate(self, measures: list[str], dimensions: list[str],
                     granularity: str | None = None) -> "PreAggregate":
        parts = [c.alias(n) for m in measures for n, c in self.measures[m].parts()]
        table = self.fact.groupBy(*self._dims(dimensions, granularity)).agg(*parts)
        return PreAggregate(table, {m: self.measures[m] for m in measures}, dimensions, granularity)


COARSER = {"hour": {"day", "week", "month", "year"}, "day": {"week", "month", "year"},
           "week": set(), "month": {"year"}}


def coarser(b: Column, granularity: str) -> Column:
    """A finer bucket's bucket of a coarser granularity."""
    if granularity == "year":
        return F.year(b)
    return b if granularity == "hour" else F.to_date(F.date_trunc(granularity, b))


@dataclass
class PreAggregate:
    table: DataFrame
    measures: dict[str, Measure]
    dimensions: list[str]
    granularity: str | None

    def persist(self, store, name: str) -> "PreAggregate":
        """Write the pre-aggregate to a store's table and return one backed by
        it, so later queries read the small rollup instead of the star join."""
        store.replace(name, self.table)
        return PreAggregate(store.read(name), self.measures, self.dimensions, self.granularity)

    def answer(self, measures: list[str], dimensions: list[str],
               granularity: str | None = None) -> DataFrame:
        """Answer a coarser query from the pre-aggregate, or raise."""
        if not set(dimensions) <= set(self.dimensions):
            raise ValueError("dimensions not covered by the pre-aggregate")
        if granularity and granularity != self.granularity and \
                granularity not in COARSER.get(self.granularity or "", set()):
            raise ValueError(f"cannot roll {self.granularity} up to {granularity}")
        keys = [F.col(d) for d in dimensions]
        if granularity:
            keys.append(coarser(F.col(self.granularity), granularity).alias(granularity))
        return self.table.groupBy(*keys).agg(*[self.measures[m].reaggregate().alias(m) for m in measures])
