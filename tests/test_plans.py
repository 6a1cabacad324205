"""What Catalyst makes of the jobs: pushdown, pruning, join types, shuffles."""

import re

import pytest
from conftest import SF_DIR

import __spark_entry__ as driver
from tablemill import Connection, plan_job
from tablemill import operators as op
from tablemill.runner import explain_text


@pytest.fixture
def large(spark):
    """Plan as if nothing were small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(spark, name):
    return explain_text(driver.queries()[name](spark, SF_DIR))


def scans(text):
    """File name -> (pushed filters, columns read); of several scans of a file the widest."""
    found = re.findall(
        r"Location: \S+ \[\S*/(\w+)\.parquet\]\n(?:PushedFilters: \[(.*?)\]\n)?ReadSchema: struct<(.*?)>",
        text,
    )
    found.sort(key=lambda scan: scan[2].count(":"))
    return {name: (pushed, re.findall(r"(\w+):", columns)) for name, pushed, columns in found}


def exchanges(text):
    return len(re.findall(r"^\(\d+\) Exchange", text, re.M))


def test_frequency(large):
    text = plan(large, "job_customer_order_frequency")
    read = scans(text)
    assert "EqualTo(o_orderstatus,F)" in read["orders"][0]
    assert read["orders"][1] == ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]
    assert read["customer"][1] == ["c_custkey", "c_acctbal"]
    # Customers and orders once each, orders after a partial aggregate; twice those orders whose
    # month has no bit. The filter on them reaches the scan.
    assert exchanges(text) == 4 and text.count("partial_bit_or") == 8 and "Expand" not in text
    assert re.search(r"Or\(LessThan\(o_orderdate,1990-01-01T00:00\),GreaterThanOrEqual\(o_orderdate,2032-09-01", text)


@pytest.mark.parametrize("name", ["job_customer_order_frequency", "agg_distinct_months", "ratio_nullif_round"])
def test_months_need_one_shuffle(large, name):
    """The branch for other months is gone from the plan that ran."""
    query, limit = driver.queries()[name], "spark.sql.adaptive.autoBroadcastJoinThreshold"
    large.conf.set(limit, "-1")
    frame = query(large, SF_DIR)
    ran = final_plan(frame)
    large.conf.unset(limit)
    assert "count(distinct" not in ran and "Join" in frame._jdf.queryExecution().optimizedPlan().toString()
    assert ran.count("Exchange hashpartitioning") == (1 if name == "agg_distinct_months" else 2)


def test_customer_sales(large):
    read = scans(plan(large, "job_customer_sales_summary"))
    assert "EqualTo(o_orderstatus,F)" in read["orders"][0]
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in read["orders"][0]
    assert "GreaterThan(c_acctbal,0.0)" in read["customer"][0]
    assert read["part"][1] == ["p_partkey"]
    assert read["lineitem"][1] == ["l_orderkey", "l_partkey", "l_extendedprice"]


def test_product_sales_is_an_inner_join(large):
    text = plan(large, "job_product_sales_summary")
    assert re.findall(r"Join type: (\w+)", text) == ["Inner", "Inner"]
    kept = plan(large, "job_product_sales_summary_keep_unmatched")
    assert sorted(re.findall(r"Join type: (\w+)", kept)) == ["Inner", "LeftOuter"]


def test_product_lines_are_summed_before_the_shuffle(large):
    text = plan(large, "job_product_sales_summary")
    partial = re.findall(r"HashAggregate\nInput.*\nKeys.*\nFunctions \[3\]: \[partial_count", text)
    assert len(partial) == 1


def test_inventory_is_one_filtered_scan(large):
    text = plan(large, "job_product_inventory_report")
    pushed, columns = scans(text)["part"]
    assert "LessThanOrEqual(p_size,40)" in pushed and "EqualTo(p_brand,Brand#13)" in pushed
    assert columns == ["p_partkey", "p_name", "p_brand", "p_size"] and exchanges(text) == 0
    every = plan(large, "job_product_inventory_report_all_categories")
    assert scans(every)["part"][0] == "IsNotNull(p_size), LessThanOrEqual(p_size,40)"


def test_left_join_has_no_outer_join_to_skew(large):
    text = plan(large, "join_left_keep_unmatched")
    assert set(re.findall(r"Join type: (\w+)", text)) == {"Inner", "LeftAnti"}


@pytest.fixture
def skewed(large, tmp_path):
    """Tables where one product and one customer hold a third, and low skew limits."""
    limits = {
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: large.conf.get(key, None) for key in limits}
    for key, value in limits.items():
        large.conf.set(key, value)
    ids = large.range(0, 24000, 1, 8)
    hot = "CASE WHEN id % 3 = 0 THEN 1 ELSE 1 + id % 997 END"
    frames = {
        "orders": ids.selectExpr(
            "id AS order_id",
            f"{hot} AS customer_id",
            f"{hot} AS product_id",
            "CAST(id AS DECIMAL(18, 2)) AS order_amount",
            "DATE '2024-06-01' AS order_date",
            "'COMPLETE' AS status",
        ),
        "products": ids.selectExpr(
            f"{hot} AS product_id",
            "CAST(id AS STRING) AS product_name",
            "'c' AS category",
            "1 AS stock_quantity",
        ),
        "customers": ids.selectExpr(
            f"{hot} AS customer_id", "'n' AS customer_name", "1 AS total_spent", "true AS active"
        ),
    }
    connections = {}
    for name, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{name}")
    for label in ("order_headers", "order_lines"):
        connections[label] = Connection(
            label, kind="files", base_path=str(tmp_path), tables={n: n for n in frames}
        )
    yield large, frames, connections
    for key, value in before.items():
        large.conf.set(key, value) if value else large.conf.unset(key)


def final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]


def test_customer_sales_split_a_hot_product(skewed):
    spark, frames, connections = skewed
    result = plan_job(spark, "customer_sales_summary", connections=connections)
    assert "skew=true" in final_plan(result)
    # Hot orders, products and customers all meet: the pairs are counted, not made.
    hot = result.filter("cust_id = 1").collect()[0]
    orders = frames["orders"].filter("product_id = 1 AND customer_id = 1").count()
    products = frames["products"].filter("product_id = 1").count()
    customers = frames["customers"].filter("customer_id = 1").count()
    assert hot.num_orders == orders * products * customers > 10**11


def test_product_sales_split_a_hot_product(skewed):
    spark, frames, connections = skewed
    result = plan_job(spark, "product_sales_summary", connections=connections)
    text = final_plan(result)
    assert "skew=true" in text, text
    assert result.count() == 24000
    hot = result.filter("prod_id = 1 AND prod_name = '0'").collect()[0]
    assert hot.total_orders == frames["orders"].filter("product_id = 1").count()


def test_hot_keys_are_split_in_operators(skewed):
    spark, frames, _ = skewed
    orders = frames["orders"].select("product_id", "order_id")
    lookup = frames["products"].filter("product_name < '5'").select("product_id", "product_name")
    for frame, n_split in (
        (op.existence_join(orders, lookup, ["product_id"]), 1),
        (op.left_join(orders, lookup.limit(300), ["product_id"]), 2),
    ):
        text = final_plan(frame)
        assert text.count("skew=true") >= n_split, text


def test_nested_unique_keys_share_a_shuffle(large):
    frame = driver.queries()["dq_unique_key"](large, SF_DIR)
    frame.collect()
    assert "ReusedExchange" in explain_text(frame)


def test_no_python_in_any_plan(spark):
    """Table queries stay in the JVM; those on text corpora are tested with them."""
    for name in driver.table_queries():
        if name not in ("job_metrics_rows", "run_group_report"):
            text = plan(spark, name)
            workers = r"\w*(?:Python|Pandas|InArrow)\b|\w*EvalPython"
            found = re.findall(rf"^\(\d+\) ({workers}|CartesianProduct|\w*NestedLoop\w*)", text, re.M)
            assert not found, (name, found)
