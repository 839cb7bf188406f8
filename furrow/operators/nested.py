"""Nested JSON line items (R10): parse, explode, total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE_ITEM_SCHEMA = "array<struct<description:string,quantity:int,unit_price:decimal(12,2)>>"


def explode_line_items(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """One row per line item: key, description, quantity, unit_price."""
    return (df.select(key, F.from_json(json_col, LINE_ITEM_SCHEMA).alias("_items"))
            .select(key, F.inline("_items")))


def line_item_totals(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """Per parent row: item count, total quantity, sum(quantity * unit_price).

    Computed with higher-order array functions on each row's parsed array, so
    it is a narrow projection: no explode, no shuffle, no grouping.
    """
    # No row filter here: a filter would be pushed below any repartition of
    # the input and evaluate the whole upstream projection a second time.
    return (df.select(key, F.from_json(json_col, LINE_ITEM_SCHEMA).alias("_items"))
            .select(key, F.size("_items").cast("bigint").alias("items"),
                    F.aggregate("_items", F.lit(0).cast("bigint"),
                                lambda acc, x: acc + x["quantity"]).alias("quantity"),
                    F.aggregate("_items", F.lit(0).cast("decimal(18,2)"),
                                lambda acc, x: (acc + x["quantity"] * x["unit_price"])
                                .cast("decimal(18,2)")).alias("line_total")))
