"""What the four jobs must return, worked out row by row in plain Python.

Frames are collected (they are tiny), every pair of rows that meets is listed,
and only then is anything counted; no SQL and no shared code with the jobs.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

SINCE = dt.date(2024, 1, 1)


def half_up(value: Decimal, digits: int) -> Decimal:
    return value.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def mean(amounts: list[Decimal], digits: int) -> Decimal | None:
    """As a decimal with four digits more than the amounts have."""
    return half_up(sum(amounts) / len(amounts), digits + 4) if amounts else None


def total(amounts: list[Decimal]) -> Decimal | None:
    return sum(amounts) if amounts else None


class Shop:
    def __init__(self, frames):
        self.customers, self.orders, self.products = (
            frames[name].collect() for name in ("customers", "orders", "products")
        )
        self.digits = frames["orders"].schema["order_amount"].dataType.scale
        self.done = [o for o in self.orders if o.status == "COMPLETE"]
        self.recent = [o for o in self.done if o.order_date and o.order_date >= SINCE]

    def customer_order_frequency(self):
        groups = defaultdict(list)
        for c in self.customers:
            if c.active:
                met = [o for o in self.done if o.customer_id == c.customer_id is not None]
                groups[c.customer_id] += met
        for customer, met in groups.items():
            n = sum(o.order_id is not None for o in met)
            months = len({(o.order_date.year, o.order_date.month) for o in met if o.order_date})
            rate = half_up(Decimal(n) / months, 2) if months else None
            yield customer, n, months, rate

    def customer_sales_summary(self):
        listed = defaultdict(int)
        for p in self.products:
            listed[p.product_id] += p.product_id is not None
        groups = defaultdict(list)
        for c in self.customers:
            if c.active and c.customer_id is not None:
                spent = c.total_spent or 0
                tier = "Platinum" if spent > 10000 else "Gold" if spent > 5000 else "Silver"
                for o in self.recent:
                    if o.customer_id == c.customer_id:
                        groups[c.customer_id, tier] += [o] * listed[o.product_id]
        for (customer, tier), met in groups.items():
            if met:
                n = sum(o.order_id is not None for o in met)
                yield customer, tier, n, total([o.order_amount for o in met if o.order_amount is not None])

    def product_sales_summary(self, keep_unmatched=False):
        groups = defaultdict(list)
        for p in self.products:
            met = [o for o in self.recent if o.product_id == p.product_id is not None]
            if met or keep_unmatched:
                groups[p.product_id, p.product_name, p.category] += met
        for key, met in groups.items():
            amounts = [o.order_amount for o in met if o.order_amount is not None]
            n = sum(o.order_id is not None for o in met)
            yield *key, n, total(amounts), mean(amounts, self.digits)

    def product_inventory_report(self):
        for p in self.products:
            if p.stock_quantity is not None and p.stock_quantity <= 50:
                q = p.stock_quantity
                level = "Critical" if q <= 10 else "Low" if q <= 30 else "Normal"
                yield p.product_id, p.product_name, p.category, q, level
