"""Quantile buckets are found without a shuffle by group."""

import pytest
from pyspark.sql import functions as F

from furrow.functions import quantiles as Q
from furrow.session import conf_scope


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("buckets", [256, 40, 16, 3])
def test_values_find_their_buckets_without_meeting_by_group(spark, buckets):
    values = spark.createDataFrame([("g", float(i % 997), "") for i in range(3000)], "g string, v double, _at string")
    with conf_scope(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        cut = Q._cut(values, "g", "v", buckets)
        assert "BroadcastHashJoin" in plan(cut) and "SortMergeJoin" not in plan(cut)
        cuts = values.agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
        assert all(r["_b"] == sum(c < r["v"] for c in cuts) for r in cut.collect())
