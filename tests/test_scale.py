"""Chunked windows and distributed ranks against the plain forms."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from heatline.operators import scale
from heatline.operators.risk import exact_quantiles
from heatline.operators.scale import by, over_ordered, values_at_ranks, with_position


def build(w):
    frame = w.rowsBetween(-6, 0)
    return {
        "lag7": F.lag("v", 7).over(w),
        "n": F.count("v").over(frame),
        "top": F.max("v").over(frame),
    }


def unsplit(df, keys, order):
    w = Window.partitionBy(*by(keys)).orderBy(*order)
    return df.withColumns({**build(w), "pos": (F.row_number().over(w) - 1).cast("long")})


def as_set(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def series(spark, n=3000):
    """A third of the rows in one key, bursts, long gaps and repeated times."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))
        ).alias("k"),
        F.timestamp_seconds(
            F.when(F.col("id") % 2 == 0, F.col("id") % 50).otherwise(F.col("id") * 86400)
        ).alias("t"),
        "id",
        (F.col("id") * 37 % 101).cast("double").alias("v"),
    )


@pytest.mark.parametrize("limit", [7, 40, 333, 10_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_chunks_change_nothing(spark, limit, keys):
    df = series(spark)
    order = ["t", "id"]
    chunked = over_ordered(df, keys, order, 7, build, position="pos", limit=limit)
    assert as_set(chunked) == as_set(unsplit(df, keys, order))


def test_null_key_is_a_series(spark):
    df = series(spark, 500).withColumn("k", F.when(F.col("id") % 5 != 0, F.col("k")))
    chunked = over_ordered(df, ["k"], ["t", "id"], 7, build, position="pos", limit=20)
    assert as_set(chunked) == as_set(unsplit(df, ["k"], ["t", "id"]))


def test_chunks_are_bounded(spark):
    df = series(spark).withColumn("k", F.lit("one"))
    sizes = over_ordered(
        df, ["k"], ["t", "id"], 7,
        lambda w: {"rows": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))},
        limit=100,
    )
    assert sizes.agg(F.max("rows")).head()[0] <= 2 * 100


def test_short_series_need_no_routes(spark, monkeypatch):
    """Many series, all short: one plain window; with a long one beside them only that is cut."""
    df = spark.range(400_000).select(
        (F.col("id") % 4000).alias("k"), F.timestamp_seconds(F.expr("id div 4000")).alias("t"), "id",
        (F.col("id") % 101).cast("double").alias("v"),
    )
    made = []

    def counted(*args):
        found = routes(*args)
        made.extend(table.count() for _, table in found)
        return found

    routes = scale._routes
    monkeypatch.setattr(scale, "_routes", counted)
    chunked = over_ordered(df, ["k"], ["t", "id"], 7, build, limit=500)
    assert made == [] and "Join" not in chunked._jdf.queryExecution().analyzed().toString()
    long = spark.range(20_000).select(
        F.lit(-1).cast("long").alias("k"), F.timestamp_seconds("id").alias("t"), "id", F.lit(1.0).alias("v")
    )
    df = df.filter("k < 100").unionByName(long)
    chunked = over_ordered(df, ["k"], ["t", "id"], 7, build, position="pos", limit=500)
    assert as_set(chunked) == as_set(unsplit(df, ["k"], ["t", "id"]))
    assert 20_000 // 500 <= sum(made) <= 8 * 20_000 // 500


def test_series_of_other_spans_are_cut_alike(spark):
    """Each long series has buckets of its own width, from microseconds to years."""
    rows = spark.range(1200).select(
        (F.col("id") % 3).alias("k"),
        F.timestamp_micros(F.pow(F.lit(1000.0), F.col("id") % 3).cast("long") * F.col("id") * 7000).alias("t"),
        "id", F.lit(1.0).alias("v"),
    )
    chunked = over_ordered(rows, ["k"], ["t", "id"], 7, build, position="pos", limit=30)
    assert as_set(chunked) == as_set(unsplit(rows, ["k"], ["t", "id"]))


def test_text_order_is_refused(spark):
    with pytest.raises(TypeError):
        over_ordered(series(spark), ["k"], ["k"], 1, build)


def test_position_counts_from_zero(spark):
    df = with_position(series(spark, 200), [], ["t", "id"], limit=9)
    assert sorted(r[0] for r in df.select("position").collect()) == list(range(200))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60),
    copies=st.integers(1, 4), limit=st.integers(1, 20),
)
def test_ranks(spark, values, copies, limit):
    data = values * copies
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    found = values_at_ranks(
        df, [], "v", lambda n: {"first": F.lit(0), "mid": F.floor(n / 2), "last": n - 1}, limit
    )
    got = {r["rank_name"]: r["rank_value"] for r in found.collect()}
    ordered = sorted(data)
    assert got == {"first": ordered[0], "mid": ordered[len(data) // 2], "last": ordered[-1]}


def test_ranks_of_extreme_values(spark):
    top = 1.7976931348623157e308
    data = [float("-inf")] * 3 + [-top, top, 5e-324, 0.0] * 5 + [float(v) for v in range(80)] + [float("inf")] * 4
    df = spark.createDataFrame([(v,) for v in data], "v double")
    places = range(0, len(data), 9)
    found = values_at_ranks(df, [], "v", lambda n: {str(k): F.lit(k) for k in places}, 4)
    assert {int(r.rank_name): r.rank_value for r in found.collect()} == {k: sorted(data)[k] for k in places}


def test_quantiles_with_infinities_agree(spark):
    rows = [("a", float(v)) for v in range(200)] + [("a", float("inf")), ("b", float("-inf")), ("b", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    few, many = [
        sorted(map(tuple, exact_quantiles(df, ["k"], "v", {"p0": 0.0, "p95": 0.95, "p1": 1.0}, limit).collect()))
        for limit in (50, 100_000)
    ]
    assert few == many


@pytest.mark.parametrize("limit", [5, 100_000])
def test_quantiles_equal_numpy(spark, limit):
    generator = np.random.default_rng(3)
    data = {"a": generator.normal(25, 2, 700), "b": np.repeat(generator.normal(30, 1, 9), 30)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    rows += [("a", float("nan")), ("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = exact_quantiles(df, ["k"], "v", {"p95": 0.95, "p99": 0.99}, limit)
    got = {r["k"]: (r["p95"], r["p99"]) for r in out.collect()}
    assert set(got) == {"a", "b"}
    for k, values in data.items():
        assert got[k] == pytest.approx(np.quantile(values, [0.95, 0.99]), abs=1e-12)
