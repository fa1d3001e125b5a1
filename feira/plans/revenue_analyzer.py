"""Revenue analyzer bundle (C2–C4): the same result keys as the dashboard
code, each a lazy DataFrame."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from feira.operators import revenue as R


class RevenueAnalyzer:
    """``RevenueAnalyzer(order_items, products)``.

    ``prepare_data`` builds the joined frame once. With ``persist=True`` it
    is kept (memory and disk) for the many results derived from it; at very
    large scale leave it off: re-reading the pruned parquet columns is cheaper
    than caching the whole join. The six category/vendor rankings come from
    two multi-metric aggregates (one pass per key), which are kept too. Without
    ``persist`` nothing is cached. Call ``release`` when done.
    """

    def __init__(self, order_items: DataFrame, products: DataFrame, persist: bool = False):
        self.order_items = order_items
        self.products = products
        self.persist = persist
        self.order_items_detailed: DataFrame | None = None
        self.analysis_results: dict | None = None
        self._kept: list[DataFrame] = []

    def prepare_data(self) -> DataFrame:
        if self.order_items_detailed is None:
            detailed = R.prepare_data(self.order_items, self.products)
            if self.persist:
                detailed = detailed.persist(StorageLevel.MEMORY_AND_DISK)
            self.order_items_detailed = detailed
        return self.order_items_detailed

    def _per_key(self, key: str) -> DataFrame:
        """All three metric sums per key in one pass, for the six rankings; kept
        with ``persist=True`` (one row per category / vendor: small next to the items)."""
        per_key = R.revenue_by_metrics(self.prepare_data(), key)
        if not self.persist:
            return per_key
        self._kept.append(per_key.persist(StorageLevel.MEMORY_AND_DISK))
        return per_key

    def run_comprehensive_analysis(self) -> dict:
        detailed = self.prepare_data()
        kpis = R.revenue_kpis(detailed)
        by_category = self._per_key("product_category_name")
        by_vendor = self._per_key("seller_id")
        category_all = R.ranking_of(by_category, "product_category_name", "Total")
        vendor_all = R.ranking_of(by_vendor, "seller_id", "Total")
        self.analysis_results = {
            "kpis": kpis,
            "total_revenue": kpis.select("total_revenue"),
            "average_order_value": kpis.select("average_order_value"),
            "total_orders": kpis.select("total_orders"),
            "total_products": kpis.select("total_products"),
            "avg_items_per_order": kpis.select("avg_items_per_order"),
            "category_revenue_all": category_all,
            "category_revenue_freight": R.ranking_of(by_category, "product_category_name", "freight_value"),
            "category_revenue_price": R.ranking_of(by_category, "product_category_name", "price"),
            "vendor_revenue_all": vendor_all,
            "vendor_revenue_freight": R.ranking_of(by_vendor, "seller_id", "freight_value"),
            "vendor_revenue_price": R.ranking_of(by_vendor, "seller_id", "price"),
            "volume_analysis_data": R.volume_analysis_data(detailed),
            "missing_dimensional_data": R.missing_dimensional_data(detailed),
            "top_category": R.top_row(category_all, "product_category_name"),
            "top_vendor": R.top_row(vendor_all, "seller_id"),
            "order_items_detailed": detailed,
        }
        return self.analysis_results

    def get_metrics_summary(self) -> DataFrame:
        """One row with the five core KPIs."""
        if self.analysis_results is None:
            self.run_comprehensive_analysis()
        return self.analysis_results["kpis"]

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()
        if self.persist and self.order_items_detailed is not None:
            self.order_items_detailed.unpersist()


def analyze_revenue_data(order_items: DataFrame, products: DataFrame) -> dict:
    return RevenueAnalyzer(order_items, products).run_comprehensive_analysis()
