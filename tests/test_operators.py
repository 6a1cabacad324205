"""Operators and expressions on hand-made frames, against brute force."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal as D

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemill import SpecError
from tablemill import functions as fn
from tablemill import operators as op

FEW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
KEYS = st.one_of(st.none(), st.just(1), st.integers(1, 4))
ROWS = st.lists(st.tuples(KEYS, st.one_of(st.none(), st.integers(-5, 5))), max_size=25)


def bag(frame):
    return Counter(map(tuple, frame.collect()))


def frames(spark, left, right):
    return (
        spark.createDataFrame(left, "k bigint, a bigint"),
        spark.createDataFrame(right, "k bigint, b bigint"),
    )


@FEW
@given(left=ROWS, right=ROWS)
def test_left_join_equals_outer_join(spark, left, right):
    lf, rf = frames(spark, left, right)
    wanted = rf.filter("b > 0")
    assert bag(op.left_join(lf, rf, ["k"], F.col("b") > 0)) == bag(lf.join(wanted, "k", "left"))


def test_left_join_with_a_hot_key(spark):
    pick = random.Random(3)
    left = [(k, k) for k in (1, 1, 2, 3, None)]
    right = [(pick.choice([1, 1, 5, None]), i) for i in range(3000)]
    lf, rf = frames(spark, left, right)
    hits = Counter(k for k, _ in right)
    result = Counter(r[0] for r in op.left_join(lf, rf, ["k"]).collect())
    assert result == {1: 2 * hits[1], 2: 1, 3: 1, None: 1}


def test_left_join_refuses_unclear_columns(spark):
    lf = spark.createDataFrame([(1, 1)], "k int, note int")
    for rf in ("k int, NOTE int", "K int, b int"):
        with pytest.raises(SpecError):
            op.left_join(lf, spark.createDataFrame([(1, 1)], rf), ["k"])


@pytest.mark.parametrize("kind", ["decimal(38,9)", "decimal(18,2)", "decimal(38,18)", "bigint"])
def test_totals_keep_digits_and_type(spark, kind):
    amounts = [D("1.123456789"), D("-2.000000001"), D("9007199254740993.5")]
    facts = spark.createDataFrame([(1, str(a)) for a in amounts], "k int, a string").select(
        "k", F.col("a").cast("decimal(38,18)").cast(kind).alias("a")
    )
    dimension = spark.createDataFrame([(1,), (1,), (1,)], "k int")
    found = op.totals_over_join(dimension, facts, "k", ["k"], sums={"s": F.col("a")})
    joined = dimension.join(facts, "k").groupBy("k").agg(F.sum("a").alias("s"))
    assert found.schema["s"].dataType == joined.schema["s"].dataType
    assert found.first().s == joined.first().s


def test_totals_too_large_are_an_error(spark):
    facts = spark.sql("SELECT 1 AS k, CAST(repeat('9', 28) AS DECIMAL(38,9)) AS a")
    dimension = spark.range(20).selectExpr("1 AS k")
    found = op.totals_over_join(dimension, facts, "k", ["k"], sums={"s": F.col("a")})
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|ARITHMETIC_OVERFLOW"):
        found.collect()


def test_left_join_on_two_keys(spark):
    lf = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c")], "x int, y int, l string")
    rf = spark.createDataFrame([(1, 1, "r"), (1, None, "s")], "x int, y int, r string")
    assert bag(op.left_join(lf, rf, ["x", "y"])) == bag(lf.join(rf, ["x", "y"], "left"))


@FEW
@given(left=ROWS, right=ROWS)
def test_existence_join_counts_copies(spark, left, right):
    lf, rf = frames(spark, left, right)
    result = op.existence_join(lf, rf, ["k"])
    brute = Counter((k, a, sum(1 for q, _ in right if q == k)) for k, a in left if k is not None)
    assert bag(result) == Counter({row: n for row, n in brute.items() if row[2]})
    unique = rf.select("k").distinct()
    assert bag(op.existence_join(lf, unique, ["k"], unique=True)) == bag(
        op.existence_join(lf, unique, ["k"])
    )


@FEW
@given(left=ROWS, right=ROWS, keep=st.booleans())
def test_totals_over_join_equals_joining_first(spark, left, right, keep):
    lf, rf = frames(spark, left, right)
    result = op.totals_over_join(
        lf,
        rf,
        "k",
        ["k", "a"],
        counts={"n": F.col("b")},
        sums={"s": F.col("b")},
        averages={"m": F.col("b")},
        distincts={"d": F.col("b")},
        keep_unmatched=keep,
    )
    joined = lf.join(rf.withColumnRenamed("k", "q"), F.col("k") == F.col("q"), "left" if keep else "inner")
    plain = joined.groupBy("k", "a").agg(
        F.count("b").alias("n"),
        F.sum("b").alias("s"),
        F.avg("b").alias("m"),
        F.count_distinct("b").alias("d"),
    )
    assert bag(result) == bag(plain)


def test_totals_need_the_join_key(spark):
    lf, rf = frames(spark, [(1, 1)], [(1, 1)])
    with pytest.raises(ValueError):
        op.totals_over_join(lf, rf, "k", ["a"], counts={"n": F.col("b")})


def test_rename(spark, caplog):
    frame = spark.createDataFrame([(1, 2, 3)], "a int, b int, C int")
    assert op.rename_columns(frame, {"a": "b", "b": "a", "c": "d"}).columns == ["b", "a", "d"]
    assert op.rename_columns(frame, {"x": "y"}).columns == ["a", "b", "C"]
    assert "absent" in caplog.text
    assert op.rename_columns(frame, None) is frame
    with pytest.raises(SpecError):
        op.rename_columns(frame, {"x": "y"}, strict=True)
    with pytest.raises(SpecError):
        op.rename_columns(frame, {"a": "y", "A": "z"})


def test_star_over_a_join(spark, shop):
    both = shop["customers"].join(
        shop["orders"], shop["customers"].customer_id == shop["orders"].customer_id
    )
    assert both.columns.count("customer_id") == 2
    assert op.rename_columns(both, {"customer_id": "c"}).columns.count("c") == 2
    with pytest.raises(SpecError, match="customer_id"):
        op.require_unique_columns(both)
    once = op.inner_join(shop["customers"], shop["orders"], ["customer_id"])
    assert op.require_unique_columns(once).columns.count("customer_id") == 1


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    "spent, tier",
    [(None, "S"), (5000, "S"), (5001, "G"), (10000, "G"), (10001, "P")],
)
def test_band_lower(spark, spent, tier):
    band = fn.band(F.lit(spent).cast("int"), [(10000, "P"), (5000, "G")], "S", side="lower")
    assert value(spark, band) == tier


@pytest.mark.parametrize("stock, status", [(10, "C"), (11, "L"), (30, "L"), (31, "N"), (None, "N")])
def test_band_upper(spark, stock, status):
    assert value(spark, fn.band(F.lit(stock).cast("int"), [(10, "C"), (30, "L")], "N")) == status


def test_band_needs_cuts(spark):
    with pytest.raises(ValueError):
        fn.band(F.lit(1), [], "x")
    with pytest.raises(ValueError):
        fn.band(F.lit(1), [(1, "a")], "x", side="middle")


@pytest.mark.parametrize(
    "n, d, expected",
    [(1, 3, "0.33"), (2, 3, "0.67"), (9, 8, "1.13"), (107, 40, "2.68"), (1, 200, "0.01"), (0, 5, "0.00"), (5, 0, None)],
)
def test_guarded_ratio(spark, n, d, expected):
    ratio = value(spark, fn.guarded_ratio(F.lit(n).cast("bigint"), F.lit(d).cast("bigint")))
    assert ratio == (None if expected is None else D(expected))


def test_months(spark):
    day = F.lit(dt.date(2024, 2, 29))
    assert value(spark, fn.month_start(day).cast("string")) == "2024-02-01 00:00:00"
    moment = F.lit("2024-12-31 23:59:59.999").cast("timestamp_ntz")
    assert value(spark, fn.month_start(moment).cast("string")) == "2024-12-01 00:00:00"


def test_predicates(spark):
    frame = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "a"), (dt.date(2023, 12, 31), "a"), (None, "b")], "d date, c string"
    )
    assert frame.filter(fn.since(F.col("d"), dt.date(2024, 1, 1))).count() == 1
    for unset in (None, ""):
        assert frame.filter(fn.matches_if_set(F.col("c"), unset)).count() == 3
    assert frame.filter(fn.matches_if_set(F.col("c"), "b")).count() == 1


# The window's edges, sentinels far outside, and ordinary days.
DAYS = st.one_of(
    st.none(),
    st.sampled_from(
        [dt.date(*d) for d in ((1, 1, 1), (1989, 12, 31), (1990, 1, 1), (2032, 8, 31), (2032, 9, 1), (9999, 12, 31))]
    ),
    st.dates(dt.date(1984, 1, 1), dt.date(2040, 1, 1)),
)


@FEW
@given(
    rows=st.lists(st.tuples(KEYS, DAYS, st.one_of(st.none(), st.integers(0, 9))), max_size=40),
    kind=st.sampled_from(["date", "timestamp", "timestamp_ntz"]),
    window=st.sampled_from([op.MonthWindow(), op.MonthWindow(2000, 1)]),
)
def test_months_as_bits_equal_count_distinct(spark, rows, kind, window):
    facts = spark.createDataFrame(rows, "k bigint, d date, n int").withColumn("d", F.col("d").cast(kind))
    by_bits = op.totals_by_key(
        facts, ["k"], counts={"n": F.col("n")}, months={"months": F.col("d")}, window=window
    )
    plain = facts.groupBy("k").agg(
        F.count("n").alias("n"), F.count_distinct(fn.month_start(F.col("d"))).alias("months")
    )
    assert by_bits.schema["months"].dataType == plain.schema["months"].dataType
    assert bag(by_bits) == bag(plain)
    people = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (7, "c"), (None, "d")], "k bigint, g string")
    months = {"months": F.col("d")}
    for by in (["k"], ["k", "g"]):
        joined = op.totals_over_join(people, facts, "k", by, {"n": F.col("n")}, months=months, window=window)
        wanted = people.join(facts, "k", "left").groupBy(*by).agg(
            F.count("n").alias("n"), F.count_distinct(fn.month_start(F.col("d"))).alias("months")
        )
        assert bag(joined) == bag(wanted)


def test_month_windows():
    window = op.MonthWindow()
    assert (window.start, window.end) == (dt.date(1990, 1, 1), dt.date(2032, 9, 1))
    for wrong in ({"words": 0}, {"first_year": 0}, {"first_year": 9990}):
        with pytest.raises(ValueError):
            op.MonthWindow(**wrong)
