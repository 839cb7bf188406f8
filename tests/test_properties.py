"""Property tests: the distributed operators against sequential brute force."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from furrow.functions.quantiles import exact_quantiles
from furrow.operators import conflicts as C

ROWS = st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abcdef")), st.integers(0, 9)),
                min_size=0, max_size=40)


def _sequential_insert_ignore(existing_keys, rows):
    """The seed loader's behaviour: rows in arrival order, a row whose key is
    taken (in the table or earlier in the load) is skipped, NULL keys pass."""
    taken, out = set(existing_keys), []
    for seq, (k, v) in enumerate(rows):
        if k is not None and k in taken:
            continue
        if k is not None:
            taken.add(k)
        out.append((k, seq, v))
    return sorted(out, key=lambda r: r[1])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(existing=st.lists(st.sampled_from("abcdefgh"), max_size=4, unique=True), rows=ROWS)
def test_insert_ignore_matches_sequential_load(spark, existing, rows):
    schema = "k string, seq int, v int"
    inc = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(rows)], schema)
    ex = spark.createDataFrame([(k, -1, 0) for k in existing], schema)
    got = sorted((tuple(r) for r in C.insert_ignore(ex, inc, "k", ["seq"]).collect()), key=lambda r: r[1])
    assert got == _sequential_insert_ignore(existing, rows)


def test_quantiles_edge_cases(spark):
    df = spark.createDataFrame([("const", 5.0)] * 7 + [("one", 2.5)], "g string, v double")
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, "g", "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert all(got[("const", p)] == 5.0 for p in [0.0, 0.5, 0.95, 1.0])
    assert all(got[("one", p)] == 2.5 for p in [0.0, 0.5, 0.95, 1.0])


GROUPS = st.lists(st.tuples(st.one_of(st.none(), st.sampled_from([0, 0, 0, 1, 2])),
                            st.integers(0, 6), st.integers(-5, 5)),
                  min_size=1, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=GROUPS, chunks=st.integers(1, 5))
def test_ordered_window_equals_window(spark, rows, chunks):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from furrow.functions.ordered_window import ordered_window
    df = spark.createDataFrame([(g, t, i, float(v)) for i, (g, t, v) in enumerate(rows)],
                               "g int, t int, i int, v double")
    got = ordered_window(df, ["g"], ["t", "i"], row_number="rn", rank="rk",
                         running_sums={"rs": "v"}, lags={"pv": "v"}, leads={"nv": "v"}, chunks=chunks)
    w = Window.partitionBy("g").orderBy("t", "i")
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("rn"),
                     F.rank().over(w).cast("bigint").alias("rk"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"),
                     F.lag("v").over(w).alias("pv"), F.lead("v").over(w).alias("nv"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=GROUPS, k=st.integers(1, 4), salts=st.integers(1, 6))
def test_top_k_per_group_equals_row_number(spark, rows, k, salts):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from furrow.functions.topk import top_k_per_group
    df = spark.createDataFrame([(g, t, i) for i, (g, t, _) in enumerate(rows)], "g int, t int, i int")
    order = [F.desc("t"), F.asc("i")]
    got = top_k_per_group(df, ["g"], order, k, salts=salts)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))) \
        .where(F.col("rank") <= k)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


FEED = st.lists(st.tuples(st.one_of(st.none(), st.just(""), st.sampled_from(["a@x", "b@x", "c@x", "A@x"])),
                          st.one_of(st.none(), st.sampled_from(["Ann", "Bo", ""]))),
                min_size=0, max_size=30)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=FEED)
def test_customer_dimension_matches_sequential_normaliser(spark, rows):
    from furrow.operators import normalize as N
    expected, next_id = {}, 1
    for email, name in rows:              # the seed normaliser's loop
        if not email or email in expected:
            continue
        expected[email] = (next_id, name, "")
        next_id += 1
    feed = spark.createDataFrame([(i, e, n) for i, (e, n) in enumerate(rows)],
                                 "seq bigint, customer_email string, customer_name string")
    got = {r.email: (r.id, r.name, r.phone) for r in N.customer_dimension(feed, "seq").collect()}
    assert got == expected


PFEED = st.lists(st.tuples(st.one_of(st.none(), st.just(""), st.sampled_from(["S1", "S2"])),
                           st.one_of(st.none(), st.just(""), st.sampled_from(["S2", "S3"])),
                           st.one_of(st.none(), st.just(""), st.just("Widget")),
                           st.one_of(st.none(), st.just("Alt"))),
                 min_size=0, max_size=25)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=PFEED)
def test_product_dimension_fallbacks_match_sequential_normaliser(spark, rows):
    from furrow.operators import normalize as N
    expected, next_id = {}, 1
    for psku, sku, pname, name in rows:   # key: product_sku or sku; name: product_name or name
        key = psku or sku
        if not key or key in expected:
            continue
        expected[key] = (next_id, pname or name)
        next_id += 1
    feed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "seq bigint, product_sku string, sku string, product_name string, name string")
    got = {r.sku: (r.id, r.name) for r in N.product_dimension(feed, "seq").collect()}
    assert got == expected
