"""Orders analyzer bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from feira.functions.delay import normalize_delay
from feira.operators import delivery as D
from feira.sources.schemas import ORDERS_REQUIRED, require_columns


# The result keys that hold one figure each.
KPI_KEYS = ("total_orders", "delivered_orders", "not_delivered_orders", "delivery_rate", "on_time_rate")


class OrdersAnalyzer:
    """``OrdersAnalyzer(orders)``: normalises ``Delay`` once (see
    ``normalize_delay`` for ``unit`` and ``on_error``); the input is never
    modified."""

    def __init__(self, orders: DataFrame, unit: str = "ns", on_error: str = "fail"):
        require_columns(orders, ORDERS_REQUIRED, "orders")
        self.orders = normalize_delay(orders, unit=unit, on_error=on_error)

    def get_delivery_performance(self) -> dict:
        """KPI row, its five figures by key (one-row frames) and the four
        labelled row-level buckets. Buckets keep the order's columns; being
        lazy, each reads only those that its consumer selects."""
        buckets = D.delivery_buckets(self.orders)
        kpis = D.delivery_performance(self.orders)
        result = {"kpis": kpis, "buckets": buckets}
        for name in KPI_KEYS:
            result[name] = kpis.select(name)
        for name in D.BUCKETS:
            result[name] = buckets.filter(buckets.bucket == name)
        return result

    def get_delayed_orders_by_stage(self, delivery_status: str = "Delivered",
                                    pct_col: str = "Site_Real_PCT") -> DataFrame:
        return D.delayed_orders(self.orders, delivery_status, pct_col)


def analyze_orders_data(orders: DataFrame, unit: str = "ns", on_error: str = "fail") -> dict:
    analyzer = OrdersAnalyzer(orders, unit=unit, on_error=on_error)
    return {"analyzer": analyzer, "performance": analyzer.get_delivery_performance(),
            "orders_data": analyzer.orders}
