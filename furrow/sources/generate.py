"""Synthetic table generation (G1-G10) as one distributed column-expression job.

Every field is a pure SQL expression of ``row_id``: randomness comes from md5
slices of ``seed|schema|field|row_id`` (four 30-bit draws per md5), so a row's
values never depend on partitioning, task order or retries, and the same text
(rendered in the DuckDB dialect) reproduces the table in the oracle. No Python
runs per row; the generated projection stays inside whole-stage codegen.

Input rows come either from ``spark.range`` (``generate``) or from any
DataFrame carrying a ``row_id`` column (``generate_for``), e.g. the keys of an
existing table, so that one generated row stands for one source row.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.sources.schemas import (DAYS_AFTER_MAX, LINE_ITEMS, LINE_QUANTITY, LINE_UNIT_PRICE,
                                    NULL_SHARE, TableSchema, get_schema)

# Value pools for person / company / place / phrase fields. These are our own
# small lists; only enumerations in schemas.py must match the reference.
FIRST_NAMES = ["Ada", "Ben", "Cara", "Dev", "Elena", "Farid", "Grace", "Hugo", "Iris", "Jonas",
               "Kira", "Liam", "Maya", "Noah", "Olga", "Pablo", "Quinn", "Rosa", "Sami", "Tara",
               "Uma", "Victor", "Wen", "Yara"]
LAST_NAMES = ["Abbott", "Baker", "Castillo", "Dubois", "Eriksen", "Fischer", "Garcia", "Haddad",
              "Ito", "Jensen", "Kowalski", "Lopez", "Moreau", "Nakamura", "Okafor", "Petrov",
              "Quist", "Rossi", "Silva", "Tanaka", "Usman", "Varga", "Weber", "Young"]
COMPANY_SUFFIX = ["Inc", "LLC", "Group", "Ltd", "Partners", "Co"]
JOBS = ["Accountant", "Analyst", "Architect", "Buyer", "Chemist", "Consultant", "Designer",
        "Engineer", "Manager", "Nurse", "Pharmacist", "Planner", "Surveyor", "Teacher",
        "Technician", "Writer"]
STREETS = ["Oak", "Maple", "Cedar", "Pine", "Elm", "Birch", "Willow", "Lake", "Hill", "River",
           "Park", "Main"]
STREET_SUFFIX = ["St", "Ave", "Rd", "Blvd", "Ln", "Way", "Dr", "Ct"]
CITIES = ["Springfield", "Riverton", "Lakeside", "Fairview", "Georgetown", "Ashland", "Clinton",
          "Franklin", "Greenville", "Madison", "Oakdale", "Salem", "Bristol", "Dover", "Milton",
          "Newport"]
STATES = ["AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA",
          "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
          "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT",
          "VA", "WA", "WV", "WI", "WY"]
COUNTRIES = ["United States", "Canada", "Mexico", "Brazil", "Argentina", "United Kingdom", "France",
             "Germany", "Spain", "Italy", "Netherlands", "Sweden", "Poland", "India", "Japan",
             "Australia", "Kenya", "Egypt", "South Africa", "New Zealand"]
ADJECTIVES = ["Adaptive", "Balanced", "Compact", "Durable", "Efficient", "Flexible", "Integrated",
              "Modular", "Optimized", "Portable", "Robust", "Secure", "Smart", "Universal",
              "Versatile", "Wireless"]
NOUNS = ["adapter", "bracket", "controller", "framework", "gateway", "interface", "kit", "module",
         "monitor", "platform", "sensor", "solution", "system", "toolkit", "unit", "widget"]
WORDS = ["able", "across", "after", "against", "answer", "around", "begin", "better", "border",
         "bright", "carry", "center", "change", "clear", "common", "course", "during", "early",
         "enough", "every", "field", "follow", "garden", "ground", "happen", "island", "letter",
         "market", "measure", "moment", "nothing", "number"]
DOMAINS = ["com", "net", "org"]


class Dialect:
    """Renders the few primitives whose syntax differs between engines."""

    def __init__(self, name: str):
        if name not in ("spark", "duckdb"):
            raise ValueError(name)
        self.name = name

    def draw(self, key_sql: str, k: int) -> str:
        """Draw k (0..3) of md5(key_sql)."""
        return self.draw_of(self.number(f"md5({key_sql})", k // 2), k)

    def number(self, hex_sql: str, half: int) -> str:
        """60 bits of a digest: its hex digits 1 to 15, or 16 to 30. Reading
        digits as a number is the dear step, so two draws share it."""
        sl = f"substr({hex_sql}, {1 + 15 * half}, 15)"
        if self.name == "spark":
            return f"cast(conv({sl}, 16, 10) as bigint)"
        return f"CAST(('0x' || {sl}) AS BIGINT)"

    def draw_of(self, number: str, k: int) -> str:
        """The lower or the upper 30 bits of a number."""
        return f"({number} & {(1 << 30) - 1})" if k % 2 == 0 else self.shr(number, 30)

    def pick(self, values: list[str], h: str) -> str:
        lits = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
        if self.name == "spark":
            return f"element_at(array({lits}), cast({h} % {len(values)} + 1 as int))"
        return f"([{lits}])[{h} % {len(values)} + 1]"

    def shr(self, h: str, n: int) -> str:
        return f"shiftright({h}, {n})" if self.name == "spark" else f"({h} >> {n})"

    def ts(self, t: dt.datetime) -> str:
        s = t.strftime("%Y-%m-%d %H:%M:%S")
        return f"TIMESTAMP_NTZ'{s}'" if self.name == "spark" else f"TIMESTAMP '{s}'"

    def add_seconds(self, ts: str, x: str) -> str:
        if self.name == "spark":
            return f"timestampadd(SECOND, {x}, {ts})"
        return f"({ts} + to_seconds({x}))"

    def add_days(self, ts: str, x: str) -> str:
        if self.name == "spark":
            return f"timestampadd(DAY, {x}, {ts})"
        return f"({ts} + to_days(CAST({x} AS INTEGER)))"

    def items(self, k: str, var: str, body: str) -> str:
        """Array of ``body`` for var = 1..k."""
        if self.name == "spark":
            return f"transform(sequence(1, cast({k} as int)), {var} -> {body})"
        return f"list_transform(range(1, {k} + 1), lambda {var}: {body})"

    def struct(self, pairs: list[tuple[str, str]]) -> str:
        if self.name == "spark":
            return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in pairs) + ")"
        return "{" + ", ".join(f"'{n}': {v}" for n, v in pairs) + "}"

    def s(self, x: str) -> str:
        return f"cast({x} as string)"


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")


def _resolve_range(start, end) -> tuple[dt.datetime, dt.datetime]:
    """G2 defaults: the year before now. ``YYYY-MM-DD`` means midnight."""
    def parse(v):
        if v is None or isinstance(v, dt.datetime):
            return v
        if isinstance(v, dt.date):
            return dt.datetime(v.year, v.month, v.day)
        return dt.datetime.strptime(v, "%Y-%m-%d")
    s, e = parse(start), parse(end)
    now = dt.datetime.now().replace(microsecond=0)
    e = e or now
    s = s or (e - dt.timedelta(days=365))
    if s > e:
        raise ValueError(f"start {s} is after end {e}")
    return s, e


class _Ctx:
    def __init__(self, schema: TableSchema, d: Dialect, seed: int, start, end, row_id: str,
                 shared: bool = False):
        self.schema, self.d, self.seed, self.row_id = schema, d, seed, row_id
        self.start, self.end = _resolve_range(start, end)
        # shared=True: every distinct md5 key becomes one column of a first
        # projection (``_m0``, ``_m1``, ...) and draws read slices of it.
        self.shared = shared
        self.hashes: dict[str, str] = {}
        self.numbers: dict[tuple[str, int], str] = {}   # (hash column, half) -> number column
        self.slots: dict[tuple[str, int], int] = {}

    def key(self, group: str, extra: str | None = None) -> str:
        base = f"'{self.seed}|{self.schema.name}|{group}|'"
        if extra is not None:
            base = f"{base} || {self.d.s(extra)} || '|'"
        return f"{base} || {self.d.s(self.row_id)}"

    def h(self, group: str, k: int = 0, extra: str | None = None) -> str:
        """Draw ``k`` of ``group``. Plain draws are handed out in order from a
        per-row pool (md5 of ``pool#n`` gives four), so a row costs one md5
        per four draws; draws keyed by an item number keep their own md5."""
        if extra is None:
            slot = self.slots.setdefault((group, k), len(self.slots))
            group, k = f"pool#{slot // 4}", slot % 4
        key = self.key(group, extra)
        if self.shared and (extra is None or extra.isdigit()):
            col = self.hashes.setdefault(key, f"_m{len(self.hashes)}")
            return self.d.draw_of(self.numbers.setdefault((col, k // 2), f"_n{len(self.numbers)}"), k)
        return self.d.draw(key, k)

    def time(self) -> str:
        span = int((self.end - self.start).total_seconds())
        draw = self.h(self.schema.time_field)
        if span > 1 << 30:  # more seconds than one draw can tell apart
            draw = f"({draw} * {1 << 30} + {self.h(self.schema.time_field, 9)})"
        off = f"{draw} % {max(span, 1)}"
        return self.d.add_seconds(self.d.ts(self.start), off)


def _pad(d: Dialect, x: str, n: int) -> str:
    return f"lpad({d.s(x)}, {n}, '0')"


def _sentence(c: _Ctx, group: str, n_words: int) -> str:
    d = c.d
    words = []
    for i in range(n_words):
        h = c.h(f"{group}#{i // 8}", (i % 8) // 2)
        words.append(d.pick(WORDS, d.shr(h, 8) if i % 2 else h))
    s = " || ' ' || ".join(words)
    return f"upper(substr({words[0]}, 1, 1)) || substr({s}, 2) || '.'"


def _value(c: _Ctx, name: str, gen: tuple) -> str:
    d = c.d
    kind = gen[0]
    h = c.h(name)
    if kind == "time":
        return c.time()
    if kind == "after":
        return d.add_days(c.time(), f"{h} % {DAYS_AFTER_MAX + 1}")
    if kind == "pick":
        return d.pick(gen[1], h)
    if kind == "int":
        lo, hi = gen[1], gen[2]
        return f"cast({lo} + {h} % {hi - lo + 1} as int)"
    if kind == "money":
        lo, hi = gen[1], gen[2]
        return f"cast(({lo * 100} + {h} % {(hi - lo) * 100 + 1}) / 100 as decimal(12,2))"
    if kind == "rate":
        hi = int(round(gen[2] * 10000))
        return f"cast(({h} % {hi + 1}) / 10000 as decimal(5,4))"
    if kind == "bool":
        return f"({h} % 100 < {gen[1]})"
    if kind == "key":
        prefix, length = gen[1], gen[2]
        hx = f"hex({c.row_id})"
        idp = f"lpad({hx}, cast(greatest(8, length({hx})) as int), '0')"
        r = length - 8
        return f"'{prefix}' || lpad(hex({h} % {16 ** r}), {r}, '0') || {idp}"
    if kind == "first_name":
        return d.pick(FIRST_NAMES, h)
    if kind == "last_name":
        return d.pick(LAST_NAMES, h)
    if kind == "person":
        return f"{d.pick(FIRST_NAMES, h)} || ' ' || {d.pick(LAST_NAMES, c.h(name, 1))}"
    if kind == "email":
        return (f"lower({d.pick(FIRST_NAMES, h)}) || '.' || lower({d.pick(LAST_NAMES, c.h(name, 1))})"
                f" || {d.s(c.row_id)} || '@example.' || {d.pick(DOMAINS, c.h(name, 2))}")
    if kind == "phone":
        return (f"{d.s(f'200 + {h} % 800')} || '-555-' || "
                f"{_pad(d, d.shr(h, 12) + ' % 10000', 4)}")
    if kind == "company":
        return f"{d.pick(LAST_NAMES, h)} || ' ' || {d.pick(COMPANY_SUFFIX, c.h(name, 1))}"
    if kind == "job":
        return d.pick(JOBS, h)
    if kind == "street":
        return (f"{d.s(f'100 + {h} % 9900')} || ' ' || {d.pick(STREETS, c.h(name, 1))}"
                f" || ' ' || {d.pick(STREET_SUFFIX, c.h(name, 2))}")
    if kind == "city":
        return d.pick(CITIES, h)
    if kind == "state":
        return d.pick(STATES, h)
    if kind == "postcode":
        return _pad(d, f"{h} % 100000", 5)
    if kind == "country":
        return d.pick(COUNTRIES, h)
    if kind == "phrase":
        return f"{d.pick(ADJECTIVES, h)} || ' ' || {d.pick(NOUNS, c.h(name, 1))}"
    if kind == "work_center":
        return f"'WC-' || {_pad(d, f'1 + {h} % {gen[1]}', 2)}"
    if kind == "text":
        n_sent, n_words = (2, 6) if gen[1] <= 200 else (5, 7)
        return " || ' ' || ".join(_sentence(c, f"{name}.{i}", n_words) for i in range(n_sent))
    if kind == "line_items":
        lo, hi = LINE_ITEMS
        k = f"({lo} + {h} % {hi - lo + 1})"
        qlo, qhi = LINE_QUANTITY
        plo, phi = LINE_UNIT_PRICE
        g = f"{name}.item"

        def item(i):
            desc = f"{d.pick(ADJECTIVES, c.h(g, 0, i))} || ' ' || {d.pick(NOUNS, c.h(g, 1, i))}"
            qty = f"cast({qlo} + {c.h(g, 2, i)} % {qhi - qlo + 1} as int)"
            price = f"({plo * 100} + {c.h(g, 3, i)} % {(phi - plo) * 100 + 1}) / 100"
            return d.struct([("description", desc), ("quantity", qty), ("unit_price", price)])
        if c.shared:
            # At most ``hi`` items: build all of them from precomputed hashes and
            # keep the first k (no per-row lambda, stays in generated code).
            arr = "array(" + ", ".join(item(str(i)) for i in range(1, hi + 1)) + ")"
            return f"to_json(slice({arr}, 1, cast({k} as int)))"
        out = f"to_json({d.items(k, 'i', item('i'))})"
        return out if d.name == "spark" else f"CAST({out} AS VARCHAR)"
    raise ValueError(f"unknown generator {kind}")


def field_exprs(schema_name: str, dialect: Dialect, seed: int = 42, start=None, end=None,
                row_id: str = "row_id", ctx: "_Ctx | None" = None) -> list[tuple[str, str]]:
    """(name, SQL expression) for every generated field, in declared order.

    G4: nullable fields are null when draw 3 of the field's md5 % 10 < 2.
    G9: the time field is rendered first by construction (D9).
    """
    schema = get_schema(schema_name)
    c = ctx or _Ctx(schema, dialect, seed, start, end, row_id)
    out = []
    for f in schema.generated_fields():
        v = _value(c, f.name, f.gen)
        if f.nullable:
            v = f"CASE WHEN {c.h(f.name, 3)} % 10 >= {round(NULL_SHARE * 10)} THEN {v} END"
        out.append((f.name, v))
    return out


def generate_for(spark: SparkSession, schema_name: str, ids: DataFrame, seed: int = 42,
                 start="2024-01-01", end="2024-12-31", row_id: str = "row_id",
                 overrides: dict | None = None) -> DataFrame:
    """G1 over given row ids: one generated row per input row (a narrow
    projection over the splits of ``ids``).

    Three projections: each distinct md5 once per row, then each number (60
    bits of an md5, as bigint) once per row, then the fields from the numbers'
    draws. Catalyst keeps them apart because md5 and conv are not cheap
    expressions to duplicate, so no string-to-number conversion is repeated.
    """
    ctx = _Ctx(get_schema(schema_name), SPARK, seed, start, end, "row_id", shared=True)
    fields = field_exprs(schema_name, SPARK, seed, start, end, "row_id", ctx=ctx)
    ids = ids.select(F.col(row_id).cast("bigint").alias("row_id"))
    hashed = ids.select("row_id",
                        *[F.expr(f"md5({k})").alias(a) for k, a in ctx.hashes.items()])
    drawn = hashed.select("row_id", *[F.expr(SPARK.number(col, half)).alias(name)
                                      for (col, half), name in ctx.numbers.items()])
    out = drawn.select("row_id", *[F.expr(e).alias(n) for n, e in fields])
    if overrides:
        # Caller-supplied field generators: any Column (or SQL text) over
        # row_id and the generated fields, cast to the declared type.
        types = {f.name: f.spark_type for f in get_schema(schema_name).generated_fields()}
        unknown = set(overrides) - set(types)
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)} for {schema_name}")
        out = out.select("row_id", *[
            ((F.expr(overrides[n]) if isinstance(overrides[n], str) else overrides[n])
             .cast(types[n]).alias(n) if n in overrides else F.col(n)) for n, _ in fields])
    return out


def generate(spark: SparkSession, schema_name: str, n: int, seed: int = 42, start=None, end=None,
             rows_per_partition: int = 100_000, overrides: dict | None = None,
             first_row: int = 0) -> DataFrame:
    """G1 from ``spark.range``: rows ``first_row`` to ``first_row + n - 1`` in
    ``ceil(n / rows_per_partition)`` partitions. The partitioning never changes
    the data."""
    if n < 0:
        raise ValueError("count must be >= 0")
    if rows_per_partition <= 0:
        raise ValueError("rows_per_partition must be > 0")
    parts = max(1, math.ceil(n / rows_per_partition))
    ids = spark.range(first_row, first_row + n, 1, parts).withColumnRenamed("id", "row_id")
    return generate_for(spark, schema_name, ids, seed, start, end, overrides=overrides)


def oracle_sql(schema_name: str, source_sql: str, seed: int = 42, start="2024-01-01",
               end="2024-12-31") -> str:
    """The DuckDB text of the same table over ``source_sql`` (which yields ``row_id``)."""
    cols = ",\n  ".join(f"{e} AS {n}" for n, e in field_exprs(schema_name, DUCKDB, seed, start, end))
    return f"SELECT CAST(row_id AS BIGINT) AS row_id,\n  {cols}\nFROM ({source_sql}) src"


def batch_plan(total: int, batch_size: int) -> list[int]:
    """Sizes of the insert batches, ``ceil(total / size)`` of them, last short."""
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    if total <= 0:
        return []
    full, rest = divmod(total, batch_size)
    return [batch_size] * full + ([rest] if rest else [])


def batches(spark: SparkSession, total: int, batch_size: int) -> DataFrame:
    """``batch_plan`` as rows (batch_no from 0, rows), for any number of batches."""
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    n = -(-max(total, 0) // batch_size)
    left = F.lit(total) - F.col("id") * batch_size
    return spark.range(n).select(F.col("id").alias("batch_no"), F.least(F.lit(batch_size), left).cast("bigint").alias("rows"))
