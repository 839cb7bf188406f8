"""Normalisation of flat feeds into dimensions and facts.

Semantics kept from the seed normaliser:

* one dimension row per distinct natural key (exact, case-sensitive match);
* attributes of the *first-seen* row win, first-seen meaning smallest ``seq``;
* ids 1, 2, ... in first-seen order;
* a null or empty key creates no entity and leaves the fact's foreign key null;
* an attribute column absent from the feed becomes ``""``.

Deliberate fixes: the denormalised columns are always dropped (even when the
key is missing), dimension ids continue from an existing dimension instead of
restarting at 1 (so a second run never points facts at the wrong entity), and
the dimension tables are named ``dim_customer`` / ``dim_product``.

Scale notes: first-seen is a ``groupBy`` + ``min_by`` (partial aggregation
before the shuffle, so a key holding a third of the rows costs one partial row
per task); ids come from :func:`furrow.functions.ids.dense_ids`; the fact
rewrite is a left equi-join that AQE turns into a broadcast join when the
measured dimension is small and otherwise keeps a sort-merge join with skewed
partitions split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.ids import dense_ids
from furrow.operators.conflicts import not_taken

CUSTOMER_SCHEMAS = ("sales_orders", "invoices")
PRODUCT_SCHEMAS = ("manufacturing_orders",)
CUSTOMER_FIELDS = ("customer_name", "customer_email", "customer_phone")
PRODUCT_FIELDS = ("product_name", "product_sku")

CUSTOMER_DIM = "dim_customer"
PRODUCT_DIM = "dim_product"


def _opt(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """Column if the feed has it, else the given default (``""``)."""
    if name in df.columns:
        return F.col(name)
    return default if default is not None else F.lit("")


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


def customer_key(feed: DataFrame) -> Column:
    return _opt(feed, "customer_email", F.lit(None).cast("string"))


def product_key(feed: DataFrame) -> Column:
    """``product_sku``, falling back to ``sku`` when the former is null/empty."""
    sku = _opt(feed, "product_sku", F.lit(None).cast("string"))
    alt = _opt(feed, "sku", F.lit(None).cast("string"))
    return F.when(_present(sku), sku).otherwise(alt)


def _first_seen(feed: DataFrame, key: Column, attrs: dict[str, Column], seq: str) -> DataFrame:
    """One row per present key: first-seen attributes and the first ``seq``."""
    packed = F.struct(*[c.alias(n) for n, c in attrs.items()])
    rows = (feed.select(key.alias("_key"), packed.alias("_a"), F.col(seq).alias("_seq"))
            .where(_present(F.col("_key"))))
    return (rows.groupBy("_key")
            .agg(F.min_by("_a", "_seq").alias("_a"), F.min("_seq").alias("first_seq")))


def customer_candidates(feed: DataFrame, seq: str) -> DataFrame:
    """Columns: email, name, phone, first_seq."""
    fs = _first_seen(feed, customer_key(feed),
                     {"name": _opt(feed, "customer_name"), "phone": _opt(feed, "customer_phone")}, seq)
    return fs.select(F.col("_key").alias("email"), "_a.name", "_a.phone", "first_seq")


def product_candidates(feed: DataFrame, seq: str) -> DataFrame:
    """Columns: sku, name, first_seq. Name falls back to ``name``."""
    pname = _opt(feed, "product_name", F.lit(None).cast("string"))
    name = F.when(_present(pname), pname).otherwise(_opt(feed, "name"))
    fs = _first_seen(feed, product_key(feed), {"name": name}, seq)
    return fs.select(F.col("_key").alias("sku"), "_a.name", "first_seq")


def _number(cands: DataFrame, key: str, start) -> DataFrame:
    return dense_ids(cands, ["first_seq", key], id_col="id", start=start)


def customer_dimension(feed: DataFrame, seq: str) -> DataFrame:
    """``id, name, email, phone``."""
    return _number(customer_candidates(feed, seq), "email", 1).select("id", "name", "email", "phone")


def product_dimension(feed: DataFrame, seq: str) -> DataFrame:
    """``id, sku, name``."""
    return _number(product_candidates(feed, seq), "sku", 1).select("id", "sku", "name")


def merge_dimension(existing: DataFrame | None, candidates: DataFrame, key: str,
                    max_id: int | None = None) -> DataFrame:
    """Keep existing rows on key conflict; new keys get ids after ``max(id)``.

    ``candidates`` is the output of ``customer_candidates`` /
    ``product_candidates`` (it carries ``first_seq``). Pass ``max_id`` when it
    is known (e.g. from table metadata) to skip the scan of the existing ids.
    """
    if existing is None:
        return new_members(None, candidates, key, 0)
    top = max_id if max_id is not None else (existing.agg(F.max("id")).first()[0] or 0)
    new = new_members(existing, candidates, key, int(top))
    return existing.select(*new.columns).unionByName(new)


def new_members(existing: DataFrame | None, candidates: DataFrame, key: str, max_id: int) -> DataFrame:
    """The rows that N5 adds: candidates whose key ``existing`` lacks, numbered
    from ``max_id + 1`` on."""
    out_cols = ["id", *[c for c in candidates.columns if c != "first_seq"]]
    if existing is not None:
        candidates = not_taken(candidates, existing, [key])
    return _number(candidates, key, max_id + 1).select(*out_cols)


def _rewrite(feed: DataFrame, key: Column, dim: DataFrame, dim_key: str,
             fk: str, drop: tuple[str, ...]) -> DataFrame:
    """Rows without a key get a probe of their own that no dimension row has,
    so that they are spread over all tasks of the join and match nothing."""
    lookup = dim.select(F.col(dim_key).alias("_key"), F.col("id").alias(fk))
    keep = [c for c in feed.columns if c not in drop]
    probe = F.when(_present(key), key).otherwise(F.concat(F.lit("\u0000"), F.xxhash64(*feed.columns).cast("string")))
    return (feed.withColumn("_key", probe)
            .join(lookup, "_key", "left")
            .select(*keep, fk))


def normalize_facts(feed: DataFrame, schema_name: str, customers: DataFrame | None = None,
                    products: DataFrame | None = None) -> DataFrame:
    """Replace denormalised columns with a foreign key; other schemas pass."""
    if schema_name in CUSTOMER_SCHEMAS:
        if customers is None:
            raise ValueError("customer dimension required")
        return _rewrite(feed, customer_key(feed), customers, "email", "customer_id", CUSTOMER_FIELDS)
    if schema_name in PRODUCT_SCHEMAS:
        if products is None:
            raise ValueError("product dimension required")
        return _rewrite(feed, product_key(feed), products, "sku", "product_id", PRODUCT_FIELDS)
    return feed


@dataclass
class Normalized:
    fact: DataFrame
    customers: DataFrame | None
    products: DataFrame | None


def normalize(feed: DataFrame, schema_name: str, seq: str,
              existing_customers: DataFrame | None = None,
              existing_products: DataFrame | None = None) -> Normalized:
    """Dimensions first (merged with existing ones), then the fact rewrite
    against the *merged* dimensions."""
    customers = products = None
    if schema_name in CUSTOMER_SCHEMAS:
        customers = merge_dimension(existing_customers, customer_candidates(feed, seq), "email")
    if schema_name in PRODUCT_SCHEMAS:
        products = merge_dimension(existing_products, product_candidates(feed, seq), "sku")
    return Normalized(normalize_facts(feed, schema_name, customers, products), customers, products)
