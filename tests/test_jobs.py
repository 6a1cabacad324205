"""The four jobs on hand-made frames, and against a row-by-row evaluation."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal as D

import fixtures
import pytest
import rowwise
from pyspark.sql import functions as F

from tablemill import ParameterError, plan_job
from tablemill.plans import shipped_job

REPORT = {"report_date": "2024-08-01"}


def planned(spark, name, frames, **params):
    """The job over frames that stand in for its declared sources."""
    sources = {k: frames[k] for k in shipped_job(name).sources}
    if "orders" in sources:
        sources["orders"] = sources["orders"].filter("status = 'COMPLETE'")
    return plan_job(spark, name, params=params, frames=sources)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: tuple(str(v) for v in r))


def test_order_frequency_edges(spark, shop):
    result = {r[0]: tuple(r)[1:] for r in planned(spark, "customer_order_frequency", shop).collect()}
    assert result == {
        1: (4, 3, D("1.33")),
        2: (2, 2, D("1.00")),
        3: (1, 0, None),  # an order without a date
        4: (1, 1, D("1.00")),  # the order without id is not counted
        7: (0, 0, None),
        8: (4, 2, D("2.00")),  # listed twice
        None: (0, 0, None),
    }


def test_sales_summary_edges(spark, shop):
    assert rows(planned(spark, "customer_sales_summary", shop)) == [
        (1, "Silver", 3, D("15.50")),
        (4, "Silver", 2, D("10.00")),
        (8, "Gold", 3, D("24.10")),
        (8, "Silver", 3, D("24.10")),
    ]


def test_product_sales_edges(spark, shop):
    result = {r[0]: tuple(r)[3:] for r in planned(spark, "product_sales_summary", shop).collect()}
    assert result == {
        10: (5, D("29.09"), D("7.272500")),
        11: (1, D("9.50"), D("4.750000")),
        13: (4, D("22.10"), D("5.525000")),
    }
    kept = planned(spark, "product_sales_summary", shop, keep_unmatched=True)
    unsold = {r[0]: tuple(r)[3:] for r in kept.collect() if r[0] not in result}
    assert unsold == {i: (0, None, None) for i in (12, 14, 15, 16, 17)}


def test_inventory_edges(spark, shop):
    status = {r[0]: r[4] for r in planned(spark, "product_inventory_report", shop, **REPORT).collect()}
    assert status == {
        10: "Critical",
        11: "Low",
        12: "Low",
        13: "Normal",
        14: "Normal",
        17: "Critical",
    }


def write_shop(frames, base):
    """The frames as Parquet tables behind one connection."""
    from tablemill import Connection

    for name, frame in frames.items():
        frame.write.parquet(f"{base}/{name}")
    names = {name: name for name in frames}
    return {
        label: Connection(label, kind="files", base_path=str(base), tables=names)
        for label in ("order_headers", "order_lines", "stock")
    }


CASES = (
    "customer_order_frequency",
    "customer_sales_summary",
    "product_inventory_report",
    "product_sales_summary",
    "product_sales_summary/keep_unmatched",
)


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("data", ["edges", "hot"])
def test_job_equals_row_by_row(spark, shop, tmp_path, name, data):
    frames = shop if data == "edges" else hot_shop(spark, seed=7)
    job, _, variant = name.partition("/")
    params = {"keep_unmatched": True} if variant else {}
    expected = getattr(rowwise.Shop(frames), job)(**params)
    if job == "product_inventory_report":
        params = REPORT
    result = plan_job(spark, job, params=params, connections=write_shop(frames, tmp_path / "in"))
    assert Counter(map(tuple, result.collect())) == Counter(expected)


@pytest.mark.parametrize("kind", ["decimal(38,9)", "decimal(18,2)", "double"])
@pytest.mark.parametrize("name", ["customer_sales_summary", "product_sales_summary"])
def test_sums_keep_digits_and_type(spark, shop, name, kind):
    """Repeated products and customers, amounts with digits far behind the point."""
    scale = {"decimal(38,9)": D("1.000000001"), "decimal(18,2)": D("1"), "double": D("0.25")}[kind]
    orders = shop["orders"].withColumn(
        "order_amount", (F.col("order_amount") * F.lit(scale)).cast(kind)
    )
    if kind == "double":
        orders = orders.withColumn("order_amount", F.round("order_amount", 0))
    result = planned(spark, name, {**shop, "orders": orders})
    sums = {"customer_sales_summary": "sales_total", "product_sales_summary": "revenue_total"}[name]
    assert result.schema[sums].dataType == orders.select(F.sum("order_amount")).schema[0].dataType
    frames = {**shop, "orders": orders}
    if kind == "double":
        frames["orders"] = orders.withColumn("order_amount", F.col("order_amount").cast("decimal(20,2)"))
    expected = list(getattr(rowwise.Shop(frames), name)())
    at = result.columns.index(sums)
    key = (lambda v: v) if kind != "double" else (lambda v: None if v is None else D(v))
    assert Counter((r[0], key(r[at])) for r in result.collect()) == Counter(
        (e[0], e[at]) for e in expected
    )


def hot_shop(spark, seed):
    """One customer, one product and NULL each hold about a third of the orders."""
    pick = random.Random(seed)

    def key(hot, low, high):
        return pick.choice([hot, None, pick.randint(low, high)])

    orders = [
        (
            pick.choice([i, i, None]),
            key(1, 1, 12),
            key(10, 10, 20),
            pick.choice([None, D(pick.randint(1, 99999)) / 100]),
            pick.choice([None, dt.date(2023, 12, 1) + dt.timedelta(days=pick.randint(0, 200))]),
            pick.choice(["COMPLETE", "COMPLETE", "PENDING", None]),
        )
        for i in range(600)
    ]
    customers = [
        (key(1, 1, 15), "x", pick.choice([None, D(pick.randint(0, 20000))]), pick.choice([True, True, None]))
        for _ in range(20)
    ]
    products = [
        (key(10, 10, 25), pick.choice("ab"), pick.choice(["u", None]), pick.choice([None, pick.randint(0, 60)]))
        for _ in range(20)
    ]
    return fixtures.shop_frames(spark, customers, orders, products)


@pytest.mark.parametrize("category, expected", [(None, 6), ("", 6), ("home", 3), ("none", 0)])
def test_category_filter(spark, shop, tmp_path, category, expected):
    params = {**REPORT, "category_filter": category}
    result = plan_job(
        spark,
        "product_inventory_report",
        params=params,
        connections=write_shop(shop, tmp_path / "in"),
    )
    assert result.dropDuplicates().count() == expected


def test_quotes_in_parameters_are_data(spark, shop, tmp_path):
    params = {**REPORT, "category_filter": "x' OR '1'='1"}
    result = plan_job(
        spark,
        "product_inventory_report",
        params=params,
        connections=write_shop(shop, tmp_path / "in"),
    )
    assert result.count() == 0


def test_report_date_is_required(spark):
    with pytest.raises(ParameterError, match="report_date"):
        plan_job(spark, "product_inventory_report")
