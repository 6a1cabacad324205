"""

Every query reads whole tables. Decimals are cast to double at the very end,
because the two engines give sums different decimal types.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

from tablemill import functions as fn  # noqa: E402
from tablemill import operators as op  # noqa: E402
from tablemill import quality, sinks, steps  # noqa: E402
from tablemill.plans import shipped_job  # noqa: E402
from tablemill.runner import plan_job, run_group, run_job  # noqa: E402
from tablemill.session import SHARE_FROM_BYTES_KEY, job_session, scratch_uri  # noqa: E402
from tablemill.sources import SourceReader, ad_hoc, load_connections  # noqa: E402
from tablemill.spec import SinkSpec, SourceSpec  # noqa: E402

# The operators on text corpora and their pipeline may be absent, together or one by one.
llm = corpus_pipeline = None
try:
    from tablemill.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("tablemill.llm", "tablemill.llm.queries"):
        raise
if llm:
    try:
        import corpus_pipeline
    except ModuleNotFoundError as missing:
        if missing.name != "corpus_pipeline":
            raise

SINCE = dt.date(2000, 1, 1)
DONE = {"completed_status": "F"}
SALES = {**DONE, "since": "2000-01-01"}
TIERS = {"platinum_above": 8000, "gold_above": 4000}
STOCK = {"report_date": "2001-08-01", "min_stock_threshold": 40}
SALES_COLUMNS = {
    "customer_sales_summary": "sales_total",
    "product_sales_summary": "revenue_total",
}
JOB_PARAMS = {
    "customer_order_frequency": DONE,
    "customer_sales_summary": {**SALES, **TIERS},
    "product_inventory_report": {**STOCK, "category_filter": "Brand#13"},
    "product_sales_summary": SALES,
}


def _connections(sf_dir: str):
    return load_connections(ROOT / "conf" / "star_tables.yaml", base_path=sf_dir)


def _reader(spark: SparkSession, sf_dir: str) -> SourceReader:
    return SourceReader(job_session(spark), _connections(sf_dir), own_session=True)


def _doubles(frame: DataFrame) -> DataFrame:
    return frame.select(
        [
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in frame.schema.fields
        ]
    )


def _completed(reader: SourceReader, label: str = "order_headers") -> DataFrame:
    return reader.table("orders", label).filter(F.col("status") == "F")


# Sources


def source_query_completed_orders(spark, sf_dir):
    source = SourceSpec.from_dict(
        "orders",
        {
            "type": "query",
            "connection": "order_headers",
            "query": "SELECT order_id, customer_id, order_date FROM orders WHERE status = :status",
        },
    )
    return _reader(spark, sf_dir).read(source, {"status": "F"})


def source_table_products(spark, sf_dir):
    session = job_session(spark)
    sources = {"products": {"type": "table", "connection": "stock", "table": "products"}}
    frames = steps.extract(session, sources, _connections(sf_dir))
    return steps.transform(
        session, frames, "SELECT product_id, product_name, category FROM products"
    )


def source_table_with_select(spark, sf_dir):
    source = SourceSpec.from_dict(
        "products",
        {
            "type": "table",
            "connection": "stock",
            "query": "SELECT product_id, stock_quantity FROM products",
        },
    )
    return _reader(spark, sf_dir).read(source)


def adhoc_query(spark, sf_dir):
    return ad_hoc(
        _reader(spark, sf_dir),
        "SELECT status, COUNT(*) AS n_orders FROM orders GROUP BY status",
        label="order_headers",
        job_id="orders by status",
    )


# Projections, renames, predicates


def project_rename_map(spark, sf_dir):
    customers = _reader(spark, sf_dir).query(
        "SELECT customer_id, customer_name, total_spent FROM customers", label="order_headers"
    )
    # The first two names swap, the third matches without regard to case.
    mapping = {
        "customer_id": "customer_name",
        "customer_name": "customer_id",
        "TOTAL_SPENT": "spent",
        "absent": "ignored",
    }
    return op.rename_columns(customers, mapping)


def filter_active_since(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    customers = reader.table("customers", "order_headers").filter(F.col("active"))
    orders = _completed(reader).filter(fn.since(F.col("order_date"), SINCE))
    joined = op.inner_join(customers, orders, ["customer_id"])
    return joined.select("customer_id", "order_id", "order_date")


def optional_category_on(spark, sf_dir):
    products = _reader(spark, sf_dir).table("products", "stock")
    return products.filter(
        (F.col("stock_quantity") <= 40) & fn.matches_if_set(F.col("category"), "Brand#13")
    )


def optional_category_off(spark, sf_dir):
    products = _reader(spark, sf_dir).table("products", "stock")
    return products.filter(
        (F.col("stock_quantity") <= 40) & fn.matches_if_set(F.col("category"), "")
    )


def case_loyalty_tier(spark, sf_dir):
    customers = _reader(spark, sf_dir).table("customers", "order_headers")
    tier = fn.band(
        F.col("total_spent"), [(8000, "Platinum"), (4000, "Gold")], "Silver", side="lower"
    )
    return customers.select("customer_id", "total_spent", tier.alias("loyalty_tier"))


def case_stock_status(spark, sf_dir):
    products = _reader(spark, sf_dir).table("products", "stock")
    status = fn.band(F.col("stock_quantity"), [(10, "Critical"), (30, "Low")], "Normal")
    return products.select("product_id", "stock_quantity", status.alias("stock_status"))


# Joins


def join_inner_orders(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    customers = reader.table("customers", "order_headers")
    joined = op.inner_join(customers, reader.table("orders", "order_headers"), ["customer_id"])
    columns = joined.select("customer_id", "customer_name", "order_id", "order_date", "status")
    return op.require_unique_columns(columns)


def join_chain_sales(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    lines = op.inner_join(
        _completed(reader, "order_lines"), reader.table("products", "order_lines"), ["product_id"]
    )
    customers = reader.table("customers", "order_lines").filter(F.col("active"))
    joined = op.inner_join(lines, customers, ["customer_id"])
    return _doubles(joined.select("customer_id", "product_id", "order_id", "order_amount"))


def join_existence_products(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    low = reader.table("products", "order_lines").filter(F.col("stock_quantity") <= 10)
    lines = op.existence_join(_completed(reader, "order_lines"), low, ["product_id"])
    return _doubles(lines.select("order_id", "product_id", "order_amount", "copies"))


def join_left_keep_zero(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    return op.totals_over_join(
        reader.table("customers", "order_headers"),
        _completed(reader),
        join_key="customer_id",
        group_by=["customer_id", "customer_name"],
        counts={"n_orders": F.col("order_id")},
    )


def join_left_null_rejecting(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    frames = {
        "listed": reader.table("products", "order_lines"),
        "sold": _completed(reader, "order_lines"),
    }
    return _doubles(
        steps.transform(
            reader.session,
            frames,
            "SELECT l.product_id, l.product_name, s.order_id, s.order_amount "
            "FROM listed AS l LEFT JOIN sold AS s ON s.product_id = l.product_id "
            "WHERE s.order_date >= :since",
            {"since": SINCE},
        )
    )


def join_left_keep_unmatched(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    joined = op.left_join(
        reader.table("products", "order_lines").select("product_id", "product_name"),
        _completed(reader, "order_lines").select(
            "product_id", "order_id", "order_amount", "order_date"
        ),
        ["product_id"],
        right_only_if=fn.since(F.col("order_date"), SINCE),
    )
    return _doubles(joined.select("product_id", "product_name", "order_id", "order_amount"))


# Aggregates and functions


def agg_product_totals(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    totals = op.totals_over_join(
        reader.table("products", "order_lines"),
        _completed(reader, "order_lines"),
        join_key="product_id",
        group_by=["product_id", "product_name", "category"],
        counts={"n_lines": F.col("order_id")},
        sums={"revenue": F.col("order_amount")},
        averages={"mean_amount": F.col("order_amount")},
        keep_unmatched=False,
    )
    return _doubles(totals)


def agg_distinct_months(spark, sf_dir):
    return op.totals_by_key(
        _completed(_reader(spark, sf_dir)),
        ["customer_id"],
        counts={"n_orders": F.col("order_id")},
        months={"n_months": F.col("order_date")},
    )


def date_trunc_month(spark, sf_dir):
    orders = _completed(_reader(spark, sf_dir))
    month = fn.month_start(F.col("order_date")).cast("timestamp_ntz")
    return op.totals_by_key(
        orders.withColumn("month", month), ["month"], counts={"n_orders": F.col("order_id")}
    )


def group_by_alias(spark, sf_dir):
    return _reader(spark, sf_dir).query(
        "SELECT CASE WHEN total_spent > :gold THEN 'high' ELSE 'low' END AS spend_class, "
        "COUNT(customer_id) AS n_customers FROM customers GROUP BY spend_class",
        {"gold": 4000},
        "order_headers",
    )


def ratio_nullif_round(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    totals = op.totals_over_join(
        reader.table("customers", "order_headers"),
        _completed(reader),
        join_key="customer_id",
        group_by=["customer_id"],
        counts={"n_orders": F.col("order_id")},
        months={"n_months": F.col("order_date")},
    )
    ratio = fn.guarded_ratio(F.col("n_orders"), F.col("n_months"))
    return _doubles(totals.withColumn("orders_per_month", ratio))


# Jobs


def _job(name: str, **more):
    def query(spark, sf_dir):
        return _doubles(
            plan_job(
                spark,
                name,
                params={**JOB_PARAMS[name], **more},
                connections=_connections(sf_dir),
            )
        )

    return query


def _run_all(spark, sf_dir) -> dict[str, object]:
    base = scratch_uri(spark, "runs")
    return {
        name: run_job(
            spark, name, params=params, connections=_connections(sf_dir), base_uri=base
        )
        for name, params in JOB_PARAMS.items()
    }


def job_metrics_rows(spark, sf_dir):
    rows = []
    for name, done in _run_all(spark, sf_dir).items():
        rows.append((name, "rows", done.metrics.rows))
        rows += [(name, f"nulls in {c}", n) for c, n in done.metrics.nulls.items()]
    return spark.createDataFrame(rows, "job string, metric string, value bigint")


def run_group_report(spark, sf_dir):
    report = run_group(
        spark,
        "GROUP:all",
        params=reduce(lambda a, b: {**a, **b}, JOB_PARAMS.values()),
        connections=_connections(sf_dir),
        base_uri=scratch_uri(spark, "group"),
    )
    return report.select("job", "status", "n_rows")


def run_group_shared(spark, sf_dir):
    """Two jobs over one view, a join, which is computed once whatever its size."""
    session = job_session(spark)
    session.conf.set(SHARE_FROM_BYTES_KEY, "0")
    base = scratch_uri(spark, "group-shared")
    report = run_group(
        session,
        ["customer_sales_summary", "product_sales_summary"],
        params={**SALES, **TIERS},
        connections=_connections(sf_dir),
        base_uri=base,
    )
    sums = [
        spark.read.parquet(f"{base}/{job}").select(
            F.lit(job).alias("job"), F.sum(amount).cast("double").alias("amount")
        )
        for job, amount in SALES_COLUMNS.items()
    ]
    amounts = reduce(DataFrame.unionByName, sums)
    return report.join(amounts, "job").select("job", "status", "n_rows", "amount")


# Sinks


def sink_parquet_roundtrip(spark, sf_dir):
    frame = source_query_completed_orders(spark, sf_dir)
    path = sinks.write_parquet(frame, scratch_uri(spark, "sink"), "completed_orders")
    return spark.read.parquet(path)


def sink_run_dated_partition(spark, sf_dir):
    """Two dates written, then the first one again with another threshold."""
    spec = replace(
        shipped_job("product_inventory_report"),
        target_table="product_inventory_report",
        sink=SinkSpec(partition_by=("report_date",)),
    )
    base = scratch_uri(spark, "dated")
    for date, threshold in (("2001-08-01", 40), ("2001-08-02", 30), ("2001-08-01", 20)):
        done = run_job(
            spark,
            spec,
            params={"report_date": date, "min_stock_threshold": threshold},
            connections=_connections(sf_dir),
            base_uri=base,
        )
    written = spark.read.parquet(done.location)
    return written.withColumn("report_date", F.col("report_date").cast("string"))


# Data quality


def dq_not_null_and_range(spark, sf_dir):
    products = _reader(spark, sf_dir).table("products", "stock")
    return quality.check(
        products,
        [
            quality.not_null("product_id"),
            quality.in_range("stock_quantity", low=5, high=45),
            quality.allowed_values("category", ["Brand#13", "Brand#21"]),
            quality.min_rows(1000),
        ],
    )


def dq_unique_key(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    return quality.check(
        reader.table("orders", "order_lines"),
        [quality.unique_key("order_id"), quality.unique_key("order_id", "product_id")],
    )


def dq_disjoint_keys(spark, sf_dir):
    """Three keys that share no column, from one scan."""
    lines = _reader(spark, sf_dir).query("SELECT * FROM line_rows", label="order_lines")
    return quality.check(
        lines,
        [
            quality.unique_key("l_orderkey", "l_partkey"),
            quality.unique_key("l_suppkey", "l_shipdate"),
            quality.unique_key("l_extendedprice"),
        ],
    )


FAILING = [
    quality.in_range("stock_quantity", low=3, high=47),
    quality.allowed_values("category", ["Brand#13", "Brand#21"]),
    quality.unique_key("category", "stock_quantity"),
    quality.orphan_key("product_id", "sold"),
]


def dq_failing_rows(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    sold = reader.table("orders", "order_lines").filter("order_amount > 90000").select("product_id")
    stock = reader.table("products", "stock").select("product_id", "category", "stock_quantity")
    rows = quality.failing_rows(stock, FAILING, {"sold": sold})
    return rows.withColumn("failed_rules", F.array_join("failed_rules", " "))


def run_group_quality(spark, sf_dir):
    """Rules in a group: one job breaks one and fails, one keeps failing rows, one passes."""
    base = scratch_uri(spark, "group-quality")
    rules = {
        "customer_order_frequency": {
            "quality": ({"rule": "not_null", "column": "cust_id"}, {"rule": "unique_key", "column": "cust_id"}),
        },
        "product_inventory_report": {
            "quality": (
                {"rule": "in_range", "column": "qty_in_stock", "low": 10},
                {"rule": "not_null", "column": "prod_id"},
            ),
            "quarantine": "stock_rejects",
        },
        "product_sales_summary": {
            "quality": ({"rule": "min_rows", "floor": 10**9}, {"rule": "unique_key", "column": "prod_id"}),
            "on_failed_rule": "fail",
        },
    }
    specs = {name: replace(shipped_job(name), **more) for name, more in rules.items()}
    params = {**SALES, **JOB_PARAMS["product_inventory_report"]}
    report = run_group(
        spark, list(specs), params, specs, connections=_connections(sf_dir), base_uri=base
    ).select("job", "status", "n_rows", "n_failed_rules")
    rejects = spark.read.parquet(f"{base}/stock_rejects").groupBy().agg(F.count("*").alias("n_rows"))
    aside = rejects.select(
        F.lit("stock_rejects").alias("job"),
        F.lit("quarantined").alias("status"),
        "n_rows",
        F.lit(1).cast("bigint").alias("n_failed_rules"),
    )
    return report.unionByName(aside)


def dq_orphan_key(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    active = reader.table("customers", "order_headers").filter(F.col("active"))
    return quality.check(
        reader.table("orders", "order_headers"),
        [quality.orphan_key("customer_id", "active_customers")],
        {"active_customers": active},
    )


def entry(spark: SparkSession) -> DataFrame:
    """Sales per customer and loyalty tier on the smallest tables."""
    return _job("customer_sales_summary")(spark, "/root/testdata/sf0.001")


def table_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries on tables; those on text corpora come on top in :func:`queries`."""
    plain = (
        source_query_completed_orders,
        source_table_products,
        source_table_with_select,
        adhoc_query,
        project_rename_map,
        filter_active_since,
        optional_category_on,
        optional_category_off,
        case_loyalty_tier,
        case_stock_status,
        join_inner_orders,
        join_chain_sales,
        join_existence_products,
        join_left_keep_zero,
        join_left_null_rejecting,
        join_left_keep_unmatched,
        agg_product_totals,
        agg_distinct_months,
        date_trunc_month,
        group_by_alias,
        ratio_nullif_round,
        job_metrics_rows,
        run_group_report,
        run_group_shared,
        sink_parquet_roundtrip,
        sink_run_dated_partition,
        dq_not_null_and_range,
        dq_unique_key,
        dq_disjoint_keys,
        dq_failing_rows,
        dq_orphan_key,
        run_group_quality,
    )
    jobs = {f"job_{name}": _job(name) for name in JOB_PARAMS}
    jobs["job_product_inventory_report_all_categories"] = _job(
        "product_inventory_report", category_filter=""
    )
    jobs["job_product_sales_summary_keep_unmatched"] = _job(
        "product_sales_summary", keep_unmatched=True
    )
    return {**{query.__name__: query for query in plain}, **jobs}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = table_queries()
    if llm:
        found |= llm.queries()
    if llm and corpus_pipeline:
        found["pipeline"] = corpus_pipeline.run
    return found


# The twins are written join first, aggregate after, so that they check the
# reordering the Spark side does.

_LINES = """(
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id,
         CAST(l_extendedprice AS DECIMAL(18, 2)) AS order_amount, o_orderdate AS order_date
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE o_orderstatus = 'F')"""

_STOCK_STATUS = """CASE WHEN p_size <= 10 THEN 'Critical'
  WHEN p_size <= 30 THEN 'Low' ELSE 'Normal' END"""


def _inventory(where: str, extra: str = "") -> str:
    return f"""
      SELECT p_partkey AS prod_id, p_name AS prod_name, p_brand AS prod_category,
             p_size AS qty_in_stock, {_STOCK_STATUS} AS stock_alert_level{extra}
      FROM part WHERE {where}"""


# Half up on whole numbers, so no binary fraction can tip a tie.
def _half_up(numerator: str, denominator: str) -> str:
    return (
        f"CASE WHEN {denominator} = 0 THEN NULL ELSE "
        f"CAST((200 * {numerator} + {denominator}) // (2 * {denominator}) AS DOUBLE) / 100 END"
    )


# A mean of DECIMAL(18, 2) has six digits after the point, rounded half up.
def _mean(amount: str) -> str:
    cents = f"CAST(SUM({amount}) * 100 AS HUGEINT)"
    n = f"COUNT({amount})"
    return (
        f"CASE WHEN {n} = 0 THEN NULL ELSE "
        f"CAST((20000 * {cents} + {n}) // (2 * {n}) AS DOUBLE) / 1000000 END"
    )


_FREQUENCY = f"""
  SELECT cust_id, total_order_count, months_active,
         {_half_up('total_order_count', 'months_active')} AS avg_monthly_orders
  FROM (
    SELECT c_custkey AS cust_id, COUNT(o_orderkey) AS total_order_count,
           COUNT(DISTINCT DATE_TRUNC('month', o_orderdate)) AS months_active
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'
    WHERE c_acctbal > 0
    GROUP BY c_custkey)"""

_CUSTOMER_SALES = f"""
  SELECT c_custkey AS cust_id,
         CASE WHEN c_acctbal > 8000 THEN 'Platinum'
              WHEN c_acctbal > 4000 THEN 'Gold' ELSE 'Silver' END AS tier,
         COUNT(s.order_id) AS num_orders,
         CAST(SUM(s.order_amount) AS DOUBLE) AS sales_total
  FROM customer
  JOIN {_LINES} AS s ON s.customer_id = c_custkey
  JOIN part ON p_partkey = s.product_id
  WHERE c_acctbal > 0 AND s.order_date >= TIMESTAMP '2000-01-01'
  GROUP BY ALL"""


def _product_sales(on: str, where: str) -> str:
    return f"""
      SELECT p_partkey AS prod_id, p_name AS prod_name, p_brand AS prod_category,
             COUNT(s.order_id) AS total_orders,
             CAST(SUM(s.order_amount) AS DOUBLE) AS revenue_total,
             {_mean('s.order_amount')} AS average_order_value
      FROM part LEFT JOIN {_LINES} AS s ON s.product_id = p_partkey {on}
      {where}
      GROUP BY p_partkey, p_name, p_brand"""


_PRODUCT_SALES = _product_sales("", "WHERE s.order_date >= TIMESTAMP '2000-01-01'")
_INVENTORY = _inventory("p_size <= 40 AND p_brand = 'Brand#13'")


def _metrics() -> str:
    outputs = {
        "customer_order_frequency": (
            _FREQUENCY,
            "cust_id total_order_count months_active avg_monthly_orders",
        ),
        "customer_sales_summary": (_CUSTOMER_SALES, "cust_id tier num_orders sales_total"),
        "product_inventory_report": (
            _INVENTORY,
            "prod_id prod_name prod_category qty_in_stock stock_alert_level",
        ),
        "product_sales_summary": (
            _PRODUCT_SALES,
            "prod_id prod_name prod_category total_orders revenue_total average_order_value",
        ),
    }
    parts = []
    for job, (sql, columns) in outputs.items():
        parts.append(f"SELECT '{job}' AS job, 'rows' AS metric, COUNT(*) AS value FROM ({sql})")
        parts += [
            f"SELECT '{job}', 'nulls in {c}', COUNT(*) - COUNT({c}) FROM ({sql})"
            for c in columns.split()
        ]
    return " UNION ALL ".join(parts)


def _rule(name: str, column: str, failed: str, table: str) -> str:
    return f"""
      SELECT '{name}' AS rule, '{column}' AS "column", COUNT(*) AS n_rows,
             CAST({failed} AS BIGINT) AS n_failed, {failed} = 0 AS passed
      FROM {table}"""


_ORDER_LINES = "orders JOIN lineitem ON l_orderkey = o_orderkey"


def _unique(columns: str, keys: str, rows: str = _ORDER_LINES) -> str:
    table = f"(SELECT COUNT(*) OVER (PARTITION BY {keys}) AS n FROM {rows})"
    return _rule("unique_key", columns, "COUNT(*) FILTER (WHERE n > 1)", table)


def oracle_sql() -> dict[str, str]:
    completed = """
      SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date
      FROM orders WHERE o_orderstatus = 'F'"""
    stock = """
      SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS category,
             p_size AS stock_quantity
      FROM part WHERE p_size <= 40"""
    months = """
      SELECT c_custkey AS customer_id, COUNT(o_orderkey) AS n_orders,
             COUNT(DISTINCT DATE_TRUNC('month', o_orderdate)) AS n_months
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'
      GROUP BY c_custkey"""
    text = llm.oracle_sql() if llm else {}
    if llm and corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        text["pipeline"] = corpus_pipeline.ORACLE_SQL
    return text | {
        "source_query_completed_orders": completed,
        "source_table_products": """
          SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS category
          FROM part""",
        "source_table_with_select": """
          SELECT p_partkey AS product_id, p_size AS stock_quantity FROM part""",
        "adhoc_query": """
          SELECT o_orderstatus AS status, COUNT(*) AS n_orders FROM orders GROUP BY 1""",
        "project_rename_map": """
          SELECT c_custkey AS customer_name, c_name AS customer_id, c_acctbal AS spent
          FROM customer""",
        "filter_active_since": """
          SELECT c_custkey AS customer_id, o_orderkey AS order_id, o_orderdate AS order_date
          FROM customer JOIN orders ON o_custkey = c_custkey
          WHERE c_acctbal > 0 AND o_orderstatus = 'F'
            AND o_orderdate >= TIMESTAMP '2000-01-01'""",
        "optional_category_on": f"{stock} AND p_brand = 'Brand#13'",
        "optional_category_off": stock,
        "case_loyalty_tier": """
          SELECT c_custkey AS customer_id, c_acctbal AS total_spent,
                 CASE WHEN c_acctbal > 8000 THEN 'Platinum'
                      WHEN c_acctbal > 4000 THEN 'Gold' ELSE 'Silver' END AS loyalty_tier
          FROM customer""",
        "case_stock_status": f"""
          SELECT p_partkey AS product_id, p_size AS stock_quantity,
                 {_STOCK_STATUS} AS stock_status
          FROM part""",
        "join_inner_orders": """
          SELECT c_custkey AS customer_id, c_name AS customer_name, o_orderkey AS order_id,
                 o_orderdate AS order_date, o_orderstatus AS status
          FROM customer JOIN orders ON o_custkey = c_custkey""",
        "join_chain_sales": f"""
          SELECT s.customer_id, s.product_id, s.order_id,
                 CAST(s.order_amount AS DOUBLE) AS order_amount
          FROM {_LINES} AS s
          JOIN customer ON c_custkey = s.customer_id
          JOIN part ON p_partkey = s.product_id
          WHERE c_acctbal > 0""",
        "join_existence_products": f"""
          SELECT s.order_id, s.product_id, CAST(s.order_amount AS DOUBLE) AS order_amount,
                 p.copies
          FROM {_LINES} AS s
          JOIN (SELECT p_partkey, COUNT(*) AS copies FROM part WHERE p_size <= 10
                GROUP BY p_partkey) AS p ON p.p_partkey = s.product_id""",
        "join_left_keep_zero": """
          SELECT c_custkey AS customer_id, c_name AS customer_name,
                 COUNT(o_orderkey) AS n_orders
          FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'
          GROUP BY c_custkey, c_name""",
        "join_left_null_rejecting": f"""
          SELECT p_partkey AS product_id, p_name AS product_name, s.order_id,
                 CAST(s.order_amount AS DOUBLE) AS order_amount
          FROM part LEFT JOIN {_LINES} AS s ON s.product_id = p_partkey
          WHERE s.order_date >= TIMESTAMP '2000-01-01'""",
        "join_left_keep_unmatched": f"""
          SELECT p_partkey AS product_id, p_name AS product_name, s.order_id,
                 CAST(s.order_amount AS DOUBLE) AS order_amount
          FROM part LEFT JOIN {_LINES} AS s
            ON s.product_id = p_partkey AND s.order_date >= TIMESTAMP '2000-01-01'""",
        "agg_product_totals": f"""
          SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS category,
                 COUNT(s.order_id) AS n_lines,
                 CAST(SUM(s.order_amount) AS DOUBLE) AS revenue,
                 {_mean('s.order_amount')} AS mean_amount
          FROM part JOIN {_LINES} AS s ON s.product_id = p_partkey
          GROUP BY p_partkey, p_name, p_brand""",
        "agg_distinct_months": """
          SELECT o_custkey AS customer_id, COUNT(o_orderkey) AS n_orders,
                 COUNT(DISTINCT DATE_TRUNC('month', o_orderdate)) AS n_months
          FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""",
        "date_trunc_month": """
          SELECT CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS month,
                 COUNT(o_orderkey) AS n_orders
          FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
        "group_by_alias": """
          SELECT CASE WHEN c_acctbal > 4000 THEN 'high' ELSE 'low' END AS spend_class,
                 COUNT(c_custkey) AS n_customers
          FROM customer GROUP BY spend_class""",
        "ratio_nullif_round": f"""
          SELECT customer_id, n_orders, n_months,
                 {_half_up('n_orders', 'n_months')} AS orders_per_month
          FROM ({months})""",
        "job_metrics_rows": _metrics(),
        "run_group_report": " UNION ALL ".join(
            f"SELECT '{job}' AS job, 'succeeded' AS status, COUNT(*) AS n_rows FROM ({sql})"
            for job, sql in (
                ("customer_order_frequency", _FREQUENCY),
                ("customer_sales_summary", _CUSTOMER_SALES),
                ("product_inventory_report", _INVENTORY),
                ("product_sales_summary", _PRODUCT_SALES),
            )
        ),
        "run_group_shared": " UNION ALL ".join(
            f"""SELECT '{job}' AS job, 'succeeded' AS status, COUNT(*) AS n_rows,
                       CAST(SUM(CAST({SALES_COLUMNS[job]} AS DECIMAL(38, 2))) AS DOUBLE) AS amount
                FROM ({sql})"""
            for job, sql in (
                ("customer_sales_summary", _CUSTOMER_SALES),
                ("product_sales_summary", _PRODUCT_SALES),
            )
        ),
        "sink_parquet_roundtrip": completed,
        "sink_run_dated_partition": " UNION ALL ".join(
            _inventory(f"p_size <= {threshold}", f", '{date}' AS report_date")
            for date, threshold in (("2001-08-01", 20), ("2001-08-02", 30))
        ),
        "dq_not_null_and_range": " UNION ALL ".join(
            [
                _rule("not_null", "product_id", "COUNT(*) - COUNT(p_partkey)", "part"),
                _rule(
                    "in_range",
                    "stock_quantity",
                    "COUNT(*) FILTER (WHERE p_size < 5 OR p_size > 45)",
                    "part",
                ),
                _rule(
                    "allowed_values",
                    "category",
                    "COUNT(*) FILTER (WHERE p_brand NOT IN ('Brand#13', 'Brand#21'))",
                    "part",
                ),
                _rule("min_rows", "", "GREATEST(1000 - COUNT(*), 0)", "part"),
            ]
        ),
        "dq_unique_key": " UNION ALL ".join(
            [
                _unique("order_id", "o_orderkey"),
                _unique("order_id,product_id", "o_orderkey, l_partkey"),
            ]
        ),
        "dq_disjoint_keys": " UNION ALL ".join(
            _unique(keys.replace(" ", ""), keys, "lineitem")
            for keys in ("l_orderkey, l_partkey", "l_suppkey, l_shipdate", "l_extendedprice")
        ),
        "dq_failing_rows": """
          SELECT * FROM (
            SELECT p_partkey AS product_id, p_brand AS category, p_size AS stock_quantity,
                   concat_ws(' ',
                     CASE WHEN p_size < 3 OR p_size > 47 THEN 'in_range(stock_quantity)' END,
                     CASE WHEN p_brand NOT IN ('Brand#13', 'Brand#21')
                          THEN 'allowed_values(category)' END,
                     CASE WHEN COUNT(*) OVER (PARTITION BY p_brand, p_size) > 1
                          THEN 'unique_key(category,stock_quantity)' END,
                     CASE WHEN p_partkey NOT IN (
                            SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                            WHERE CAST(l_extendedprice AS DECIMAL(18, 2)) > 90000)
                          THEN 'orphan_key(product_id)' END) AS failed_rules
            FROM part) WHERE failed_rules <> ''""",
        "run_group_quality": f"""
          SELECT 'customer_order_frequency' AS job, 'succeeded' AS status, COUNT(*) AS n_rows,
                 CAST(0 AS BIGINT) AS n_failed_rules FROM ({_FREQUENCY})
          UNION ALL SELECT 'product_inventory_report', 'succeeded', COUNT(*), 1 FROM ({_INVENTORY})
          UNION ALL SELECT 'product_sales_summary', 'failed_quality', COUNT(*), 1 FROM ({_PRODUCT_SALES})
          UNION ALL SELECT 'stock_rejects', 'quarantined', COUNT(*), 1
          FROM ({_INVENTORY}) WHERE qty_in_stock < 10""",
        "dq_orphan_key": _rule(
            "orphan_key",
            "customer_id",
            "COUNT(*) FILTER (WHERE o_custkey IS NOT NULL AND NOT EXISTS "
            "(SELECT 1 FROM customer WHERE c_acctbal > 0 AND c_custkey = o_custkey))",
            "orders",
        ),
        "job_customer_order_frequency": _FREQUENCY,
        "job_customer_sales_summary": _CUSTOMER_SALES,
        "job_product_inventory_report": _INVENTORY,
        "job_product_inventory_report_all_categories": _inventory("p_size <= 40"),
        "job_product_sales_summary": _PRODUCT_SALES,
        "job_product_sales_summary_keep_unmatched": _product_sales(
            "AND s.order_date >= TIMESTAMP '2000-01-01'", ""
        ),
    }
