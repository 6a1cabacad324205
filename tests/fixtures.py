"""Hand-made frames with the edge cases of the four jobs."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal


def day(text):
    return dt.date.fromisoformat(text) if text else None


def money(text):
    return Decimal(text) if text is not None else None


CUSTOMERS = [
    (1, "Ann", money("5000.00"), True),  # not above the Gold cut
    (2, "Bob", money("10000.00"), True),  # not above the Platinum cut
    (3, "Cyd", money("10000.01"), True),
    (4, "Dee", None, True),  # NULL spent: last tier
    (5, "Eve", money("7000.00"), False),
    (6, "Fay", money("7000.00"), None),  # NULL active: dropped
    (7, "Gus", money("1.00"), True),  # never ordered
    (8, "Hal", money("9000.00"), True),  # listed twice, in two tiers
    (8, "Hal", money("100.00"), True),
    (None, "Nil", money("1.00"), True),
]

# order_id, customer_id, product_id, order_amount, order_date, status
ORDERS = [
    (1, 1, 10, money("10.00"), day("2024-01-01"), "COMPLETE"),
    (2, 1, 10, None, day("2024-01-31"), "COMPLETE"),  # counted, not summed
    (3, 1, 11, money("5.50"), day("2024-02-01"), "COMPLETE"),
    (4, 2, 99, money("7.00"), day("2024-02-01"), "COMPLETE"),  # unknown product
    (5, 2, 11, money("7.25"), day("2023-12-31"), "COMPLETE"),  # before the cutoff
    (6, 3, 12, money("1.00"), None, "COMPLETE"),  # no date
    (7, 3, 12, money("2.00"), day("2024-05-05"), "PENDING"),
    (8, 4, 13, money("3.00"), day("2024-03-03"), "COMPLETE"),  # product listed twice
    (None, 4, 11, money("4.00"), day("2024-03-04"), "COMPLETE"),  # no order id
    (9, 8, 10, money("8.00"), day("2024-06-01"), "COMPLETE"),
    (10, 8, 13, money("8.05"), day("2024-07-01"), "COMPLETE"),
    (11, 5, 10, money("9.99"), day("2024-07-01"), "COMPLETE"),
    (12, None, 10, money("1.10"), day("2024-07-01"), "COMPLETE"),
    (13, 1, None, money("1.20"), day("2024-07-01"), "COMPLETE"),
]

PRODUCTS = [
    (10, "pen", "office", 10),
    (11, "ink", "office", 11),
    (12, "cup", "home", 30),
    (13, "mat", "home", 31),
    (13, "mat", "home", 31),
    (14, "rug", "home", 50),
    (15, "jar", "home", 51),
    (16, "lid", "home", None),
    (17, "pin", None, 5),
]


def shop_frames(spark, customers=CUSTOMERS, orders=ORDERS, products=PRODUCTS):
    return {
        "customers": spark.createDataFrame(
            customers,
            "customer_id bigint, customer_name string, total_spent decimal(18,2), active boolean",
        ),
        "orders": spark.createDataFrame(
            orders,
            "order_id bigint, customer_id bigint, product_id bigint, "
            "order_amount decimal(18,2), order_date date, status string",
        ),
        "products": spark.createDataFrame(
            products,
            "product_id bigint, product_name string, category string, stock_quantity int",
        ),
    }
