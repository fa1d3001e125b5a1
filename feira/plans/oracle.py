"""Independent SQL (DuckDB dialect) for every named query.

The base tables are views in the checking database; each statement starts
from the same input derivation as ``feira.sources.fixtures``, written as SQL
CTEs, and computes the result with plain SQL aggregates. Money sums go
through DECIMAL(38,16) on both sides so totals are exact; ratios are double
divisions in the same order on both sides.
"""

from __future__ import annotations

from feira.functions.bins import DEFAULT_DELAY_RANGES, PCT_EDGES, edges_from_ranges, pct_labels, range_labels
from feira.sources.fixtures import NATION_STATE
from feira.sources.states import STATES

_STATE_CASE = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(NATION_STATE))
_STATES_VALUES = ", ".join(
    f"('{s}', CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE), '{name}')" for s, lat, lon, name in STATES)

INPUTS = f"""
order_items AS (
  SELECT CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE l_orderkey END AS order_id,
    l_linenumber AS order_item_id,
    CASE WHEN l_partkey % 173 = 0 THEN NULL WHEN l_partkey % 50 = 7 THEN -l_partkey ELSE l_partkey END AS product_id,
    CASE WHEN l_suppkey % 61 = 0 THEN NULL ELSE l_suppkey END AS seller_id,
    l_extendedprice AS price,
    CASE WHEN l_linenumber = 7 THEN NULL
         ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DOUBLE) END AS freight_value,
    l_shipdate AS shipping_limit_date
  FROM lineitem),
products AS (
  SELECT p_partkey AS product_id,
    CASE WHEN p_partkey % 20 = 3 THEN NULL ELSE p_brand END AS product_category_name,
    CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE CAST(p_size * 250 AS DOUBLE) END AS product_weight_g,
    CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST(10 + p_partkey % 23 AS DOUBLE) END AS product_length_cm,
    CAST(5 + p_partkey % 17 AS DOUBLE) AS product_height_cm,
    CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE CAST(8 + p_partkey % 19 AS DOUBLE) END AS product_width_cm
  FROM part),
seller_orders AS (
  SELECT o_orderkey AS order_id,
    CASE c_nationkey {_STATE_CASE} ELSE 'XX' END AS customer_state,
    CASE WHEN o_orderstatus = 'O' THEN 'Not_Delivered'
         WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN NULL
         ELSE 'Delivered' END AS Net_State,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL
         WHEN o_orderkey % 89 = 0 THEN 0
         WHEN o_orderkey % 83 = 0 THEN (o_orderkey % 7) * (-432000)
         ELSE (o_orderkey * 7919) % 6048000 - 3024000 END AS delay_seconds,
    CASE WHEN o_orderkey % 101 = 0 THEN NULL
         ELSE CAST((o_orderkey * 31) % 1101 - 50 AS DOUBLE) / 10.0E0 END AS Site_Real_PCT,
    o_totalprice AS TOTAL, o_orderdate AS order_purchase_timestamp
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
states(state, lat, lon, state_name) AS (VALUES {_STATES_VALUES}),
detailed AS (
  SELECT oi.order_id, oi.order_item_id, oi.product_id, oi.seller_id, oi.price, oi.freight_value,
    COALESCE(p.product_category_name, 'Others') AS product_category_name,
    p.product_weight_g, p.product_length_cm, p.product_height_cm, p.product_width_cm,
    oi.price + oi.freight_value AS Total
  FROM order_items oi LEFT JOIN products p ON oi.product_id IS NOT DISTINCT FROM p.product_id),
complete AS (
  SELECT *, product_width_cm * product_height_cm * product_length_cm AS Volume_cm FROM detailed
  WHERE product_weight_g IS NOT NULL AND product_length_cm IS NOT NULL
    AND product_height_cm IS NOT NULL AND product_width_cm IS NOT NULL),
timed AS (
  SELECT *, CAST(delay_seconds AS DOUBLE) / CAST(86400 AS DOUBLE) AS delay_days FROM seller_orders)
"""


def exact(expr: str) -> str:
    """A double by its shortest decimal form (a direct cast multiplies in floating point)."""
    return f"CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,16))"


def dbl(expr: str) -> str:
    """The nearest double of a decimal."""
    return f"CAST(CAST({expr} AS VARCHAR) AS DOUBLE)"


def money(expr: str) -> str:
    return f"COALESCE({dbl(f'SUM({exact(expr)})')}, CAST(0 AS DOUBLE))"


def ratio(num: str, den: str, scale: str = "", otherwise: str = "NULL") -> str:
    body = f"{dbl(num)} / {dbl(den)}"
    if scale:
        body = f"{body} * CAST({scale} AS DOUBLE)"
    return f"CASE WHEN {den} <> 0 THEN {body} ELSE {otherwise} END"


def rounded_once(column: str, power: int = 0) -> str:
    """A total in units of 2^-60 (HUGEINT) as the nearest double times 2^power: its 61
    leading bits, the last of them set if anything follows, go through BIGINT."""
    cut = f"GREATEST(0, COALESCE(CAST(FLOOR(LOG2(CAST(NULLIF({column}, 0) AS DOUBLE))) AS INTEGER), 0) - 60)"
    unit = f"CAST(POW(2, {cut}) AS HUGEINT)"
    lead = f"(({column} // {unit}) | CASE WHEN {column} % {unit} <> 0 THEN 1 ELSE 0 END)"
    return f"CAST(CAST({lead} AS BIGINT) AS DOUBLE) * POW(2, {cut} - 60 + {power})"


def _with(body: str, extra: str = "") -> str:
    ctes = INPUTS.strip() + (",\n" + extra.strip() if extra else "")
    return f"WITH {ctes}\n{body.strip()}"


def _revenue_by(key: str, metric: str) -> str:
    where = f"WHERE {key} IS NOT NULL" if key == "seller_id" else ""
    return f"SELECT {key}, {money(metric)} AS Total FROM detailed {where} GROUP BY {key}"


def _bin_case(col: str, edges: list) -> str:
    parts = [f"WHEN {col} IS NULL OR isnan({col}) OR {col} < {edges[0]} OR {col} > {edges[-1]} THEN NULL",
             f"WHEN {col} = {edges[0]} THEN 0"]
    parts += [f"WHEN {col} <= {hi} THEN {i}" for i, hi in enumerate(edges[1:])]
    return "CASE " + " ".join(parts) + " END"


def _heatmap_ctes(where: str) -> str:
    edges, labels = edges_from_ranges(DEFAULT_DELAY_RANGES), range_labels(DEFAULT_DELAY_RANGES)
    p_labels = pct_labels()
    bins_values = ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(labels))
    counts = ", ".join(f'COUNT(x.p_idx) FILTER (WHERE x.p_idx = {i}) AS "{lab}"' for i, lab in enumerate(p_labels))
    return f"""
late AS (SELECT delay_days, Site_Real_PCT FROM timed WHERE delay_seconds < 0 {where}),
binned AS (SELECT {_bin_case('CAST(delay_days AS DOUBLE)', edges)} AS d_idx,
                  {_bin_case('Site_Real_PCT', PCT_EDGES)} AS p_idx FROM late),
bins(d_idx, delay_bin) AS (VALUES {bins_values}),
grid_rows AS (SELECT d_idx FROM bins UNION SELECT d_idx FROM binned WHERE d_idx IS NULL),
heat AS (
  SELECT r.d_idx, b.delay_bin, {counts}
  FROM grid_rows r LEFT JOIN bins b ON r.d_idx = b.d_idx
  LEFT JOIN binned x ON r.d_idx IS NOT DISTINCT FROM x.d_idx
  GROUP BY r.d_idx, b.delay_bin)"""


def _geo(metric: str, where: str, table: str = "seller_orders", extra: str = "") -> str:
    if metric == "revenue":
        value, label = money("TOTAL"), "regexp_replace(format('{:,.2f}', value), '0$', '')"
    else:
        value, label = "COUNT(DISTINCT order_id)", "format('{:,}', value)"
    return _with(f"""
SELECT j.state, j.state_name, j.lat, j.lon, j.value,
  CAST(CASE WHEN MAX(value) OVER () > MIN(value) OVER ()
       THEN 10 + 30 * (value - MIN(value) OVER ()) / (MAX(value) OVER () - MIN(value) OVER ())
       ELSE 20.0 END AS DOUBLE) * CAST(1.0 AS DOUBLE) AS bubble_size,
  j.state || '<br>' || {label} AS label
FROM (SELECT v.state, s.state_name, s.lat, s.lon, v.value FROM v JOIN states s ON v.state = s.state) j""",
                 extra + f"""v AS (SELECT customer_state AS state, {value} AS value FROM {table}
       WHERE customer_state IS NOT NULL {where} GROUP BY customer_state)""")


def _perf_cte() -> str:
    return f"""
perf AS (
  SELECT COUNT(*) AS total_orders,
    COUNT(*) FILTER (WHERE Net_State = 'Delivered') AS delivered_orders,
    COUNT(*) FILTER (WHERE Net_State = 'Not_Delivered') AS not_delivered_orders,
    COUNT(*) FILTER (WHERE delay_seconds < 0 AND Net_State = 'Delivered') AS delay_delivered,
    COUNT(*) FILTER (WHERE delay_seconds < 0 AND Net_State = 'Not_Delivered') AS delay_not_delivered,
    COUNT(*) FILTER (WHERE delay_seconds > 0 AND Net_State = 'Delivered') AS no_delay_delivered,
    COUNT(*) FILTER (WHERE delay_seconds > 0 AND Net_State = 'Not_Delivered') AS no_delay_not_delivered
  FROM seller_orders WHERE delay_seconds IS NOT NULL),
kpis AS (
  SELECT total_orders, delivered_orders, not_delivered_orders,
    {ratio('delivered_orders', 'total_orders', '100', 'CAST(0 AS DOUBLE)')} AS delivery_rate,
    {ratio('no_delay_delivered', 'delivered_orders', '100', 'CAST(0 AS DOUBLE)')} AS on_time_rate,
    delay_delivered, delay_not_delivered, no_delay_delivered, no_delay_not_delivered
  FROM perf)"""


def _chart(no_delay: str, with_delay: str) -> str:
    pct = lambda n: ratio(n, f"({no_delay} + {with_delay})", "100", "CAST(0 AS DOUBLE)")
    label = lambda n: f"format('{{:,}}', {n}) || '<br>(' || format('{{:.1f}}', {pct(n)}) || '%)'"
    return _with(f"""
SELECT 'No Delay' AS category, {no_delay} AS orders, {pct(no_delay)} AS pct, {label(no_delay)} AS label FROM kpis
UNION ALL
SELECT 'With Delay' AS category, {with_delay} AS orders, {pct(with_delay)} AS pct, {label(with_delay)} AS label
FROM kpis""", _perf_cte())


def _revenue_kpis_cte() -> str:
    return f"""
kpis AS (
  SELECT {money('Total')} AS total_revenue,
    {ratio(money("CASE WHEN order_id IS NOT NULL THEN Total END"), 'COUNT(DISTINCT order_id)')} AS average_order_value,
    COUNT(DISTINCT order_id) AS total_orders,
    COUNT(*) AS total_products,
    {ratio('COUNT(*)', 'COUNT(DISTINCT order_id)')} AS avg_items_per_order
  FROM detailed)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["order_items_detailed"] = _with("""
SELECT order_id, order_item_id, product_id, seller_id, price, freight_value, product_category_name, Total
FROM detailed""")
    q["small_value_totals"] = _with(f"""
SELECT seller_id, {money("CAST(order_id % 1000003 AS DOUBLE) / CAST(1000000 AS DOUBLE)")} AS Total
FROM order_items WHERE seller_id IS NOT NULL GROUP BY seller_id""")
    sums = ", ".join(f"COALESCE(SUM(CAST({c} * POW(2, 60) AS HUGEINT)), 0::HUGEINT)::HUGEINT AS {c}" for c in ("Total", "price", "freight_value"))
    q["vendor_totals_any_size"] = _with(f"""
SELECT seller_id, {rounded_once("Total")} AS Total, {rounded_once("price", -80)} AS price_tiny,
  {rounded_once("freight_value", 80)} AS freight_huge
FROM (SELECT seller_id, {sums} FROM detailed WHERE seller_id IS NOT NULL GROUP BY seller_id)""")
    q["order_totals"] = _with(f"SELECT order_id, {money('Total')} AS Total FROM detailed "
                              "WHERE order_id IS NOT NULL GROUP BY order_id")
    q["revenue_kpis"] = _with("SELECT * FROM kpis", _revenue_kpis_cte())
    for key, prefix in (("product_category_name", "category_revenue"), ("seller_id", "vendor_revenue")):
        for metric, suffix in (("Total", "all"), ("freight_value", "freight"), ("price", "price")):
            q[f"{prefix}_{suffix}"] = _with(_revenue_by(key, metric))
    q["missing_dimensional_data"] = _with(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count FROM detailed"
        for c in ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")))
    q["volume_analysis_data"] = _with("""
SELECT order_id, order_item_id, product_id, price, freight_value, product_weight_g, Volume_cm FROM complete""")
    q["top_category"] = _with(_revenue_by("product_category_name", "Total")
                              + " ORDER BY Total DESC, product_category_name ASC LIMIT 1")
    q["top_vendor"] = _with(_revenue_by("seller_id", "Total") + " ORDER BY Total DESC, seller_id ASC LIMIT 1")
    for name, key in (("top_categories_feed", "product_category_name"), ("top_vendors_feed", "seller_id")):
        q[name] = _with(f"""
SELECT CAST({key} AS VARCHAR) AS {key}, Total,
  'R$' || format('{{:,.0f}}', Total) AS label, 'R$' || format('{{:,.2f}}', Total) AS hover_label
FROM ({_revenue_by(key, 'Total')}) ORDER BY Total DESC, {key} ASC LIMIT 15""")
    q["freight_weight_feed"] = _with("SELECT product_weight_g, freight_value FROM complete")
    q["freight_volume_feed"] = _with("SELECT Volume_cm, freight_value FROM complete")
    q["freight_price_feed"] = _with("SELECT price, freight_value FROM complete")
    q["price_weight_volume_feed"] = _with(
        "SELECT product_weight_g, price, Volume_cm, Volume_cm / CAST(100 AS DOUBLE) AS bubble_size FROM complete")
    q["revenue_metrics_display"] = _with("""
SELECT 'R$' || format('{:,.2f}', total_revenue) AS total_revenue,
  'R$' || format('{:,.2f}', average_order_value) AS average_order_value,
  format('{:,}', total_orders) AS total_orders,
  format('{:,}', total_products) AS total_products,
  format('{:.2f}', avg_items_per_order) AS avg_items_per_order
FROM kpis""", _revenue_kpis_cte())

    q["delay_normalized"] = _with("SELECT order_id, delay_days FROM timed")
    q["delivery_performance"] = _with("SELECT * FROM kpis", _perf_cte())
    q["delivery_buckets"] = _with("""
SELECT order_id, Net_State, delay_days, bucket FROM (
  SELECT *, CASE WHEN delay_seconds < 0 AND Net_State = 'Delivered' THEN 'delay_delivered'
                 WHEN delay_seconds < 0 AND Net_State = 'Not_Delivered' THEN 'delay_not_delivered'
                 WHEN delay_seconds > 0 AND Net_State = 'Delivered' THEN 'no_delay_delivered'
                 WHEN delay_seconds > 0 AND Net_State = 'Not_Delivered' THEN 'no_delay_not_delivered'
            END AS bucket FROM timed) WHERE bucket IS NOT NULL""")
    for name, where in (("delayed_orders_delivered", "AND Net_State = 'Delivered'"),
                        ("delayed_orders_not_delivered", "AND Net_State = 'Not_Delivered'"),
                        ("delayed_orders_all", "")):
        q[name] = _with(f"SELECT order_id, Net_State, delay_days, Site_Real_PCT FROM timed "
                        f"WHERE delay_seconds < 0 {where}")
    p_cols = ", ".join(f'"{lab}"' for lab in pct_labels())
    q["delay_heatmap"] = _with(f"SELECT delay_bin, {p_cols} FROM heat", _heatmap_ctes(""))
    q["delay_heatmap_delivered"] = _with(f"SELECT delay_bin, {p_cols} FROM heat",
                                         _heatmap_ctes("AND Net_State = 'Delivered'"))
    q["delay_heatmap_long"] = _with(
        f"SELECT delay_bin, pct_bin, orders FROM (SELECT delay_bin, {p_cols} FROM heat) "
        f"UNPIVOT (orders FOR pct_bin IN ({p_cols}))", _heatmap_ctes(""))
    texts = ", ".join("CASE WHEN \"{0}\" = 0 THEN '' ELSE CAST(\"{0}\" AS VARCHAR) END AS \"{0}\"".format(lab)
                      for lab in pct_labels())
    q["delay_heatmap_text"] = _with(f"SELECT delay_bin, {texts} FROM heat", _heatmap_ctes(""))
    q["delivery_chart_delivered"] = _chart("no_delay_delivered", "delay_delivered")
    q["delivery_chart_not_delivered"] = _chart("no_delay_not_delivered", "delay_not_delivered")
    q["delivery_metrics_display"] = _with("""
SELECT format('{:,}', total_orders) AS total_orders,
  format('{:,}', delivered_orders) || ' (' || format('{:.1f}', delivery_rate) || '%)' AS delivered_orders,
  format('{:.1f}', on_time_rate) || '%' AS on_time_rate,
  format('{:,}', delay_delivered) AS delay_delivered,
  format('{:,}', delay_not_delivered) AS delay_not_delivered
FROM kpis""", _perf_cte())
    q["geo_orders"] = _geo("orders", "")
    q["geo_delayed"] = _geo("orders", "AND delay_seconds < 0")
    q["geo_revenue"] = _geo("revenue", "")
    q["geo_delivered_delayed_only"] = _geo("orders", "AND Net_State = 'Delivered' AND delay_seconds < 0")
    daily = """daily AS (SELECT CAST(order_purchase_timestamp AS DATE) AS date, COUNT(DISTINCT order_id) AS orders
  FROM seller_orders WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1)"""
    q["daily_orders"] = _with("SELECT date, orders FROM daily", daily)
    q["daily_trend_7"] = _with("""
SELECT date, orders, AVG(orders) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS orders_roll
FROM daily""", daily)
    q["daily_trend_revenue_7"] = _with("""
SELECT date, orders, AVG(orders) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS revenue_roll
FROM daily""", daily)
    _extras(q)
    _more(q)
    return q


def _ranked_cte(key: str) -> str:
    return f"""
per_key AS (
  SELECT {key}, COALESCE(SUM({exact('Total')}), CAST(0 AS DECIMAL(38,16))) AS x
  FROM detailed WHERE {key} IS NOT NULL GROUP BY {key}),
ranked AS (
  SELECT {key}, x, {dbl('x')} AS Total,
    ROW_NUMBER() OVER (ORDER BY x DESC, {key} ASC) AS position,
    COUNT(*) OVER () AS n_rows,
    SUM(x) OVER (ORDER BY x DESC, {key} ASC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
    SUM(x) OVER () AS grand_total
  FROM per_key)"""


def _extras(q: dict[str, str]) -> None:
    q["vendor_segments"] = _with(
        "SELECT seller_id, Total, position, CAST((position - 1) * 10 // n_rows + 1 AS BIGINT) AS segment "
        "FROM ranked", _ranked_cte("seller_id"))
    q["vendor_concentration"] = _with(f"""
SELECT seller_id, Total, position, {ratio('position', 'n_rows')} AS cum_vendor_share,
  {ratio('running', 'grand_total')} AS cum_revenue_share FROM ranked""", _ranked_cte("seller_id"))
    q["vendor_concentration_summary"] = _with(f"""
SELECT COUNT(*) AS n_vendors,
  CASE WHEN COUNT(*) > 0 AND SUM(x) <> 0 THEN ROUND(
    CAST(2.0 AS DOUBLE) * SUM(CAST(n_rows + 1 - position AS DOUBLE) * {dbl('x')})
      / (CAST(COUNT(*) AS DOUBLE) * {dbl('SUM(x)')})
    - (CAST(COUNT(*) AS DOUBLE) + CAST(1.0 AS DOUBLE)) / CAST(COUNT(*) AS DOUBLE), 10) END AS gini,
  CASE WHEN SUM(x) <> 0 THEN {dbl('COALESCE(SUM(CASE WHEN position <= CEIL(n_rows * 10 / 100) THEN x END), 0)')}
       / {dbl('SUM(x)')} END AS top_share
FROM ranked""", _ranked_cte("seller_id"))
    q["category_share_rank"] = _with(f"""
SELECT product_category_name, Total, {ratio('x', 'grand_total')} AS share, position AS rank,
  {ratio('running', 'grand_total')} AS cum_share FROM ranked""", _ranked_cte("product_category_name"))
    q["state_order_share"] = _with(f"""
SELECT state, orders, ROW_NUMBER() OVER (ORDER BY orders DESC, state ASC) AS rank,
  {ratio('orders', 'SUM(orders) OVER ()')} AS share
FROM (SELECT customer_state AS state, COUNT(DISTINCT order_id) AS orders FROM seller_orders
      WHERE customer_state IS NOT NULL GROUP BY customer_state)""")
    q["price_freight_correlation"] = _with("""
SELECT COUNT(*) AS n, ROUND(CORR(price, freight_value), 10) AS pearson_r
FROM complete WHERE price IS NOT NULL AND freight_value IS NOT NULL""")
    q["freight_efficiency"] = _with(f"""
SELECT product_category_name, items, freight,
  {ratio('freight * CAST(1000.0 AS DOUBLE)', 'grams')} AS freight_per_kg,
  {ratio('freight * CAST(1000.0 AS DOUBLE)', 'cm3')} AS freight_per_litre,
  {ratio('freight', 'price_sum')} AS freight_to_price
FROM (SELECT product_category_name, COUNT(*) AS items,
        {money('freight_value')} AS freight,
        {dbl('SUM(' + exact('product_weight_g') + ')')} AS grams,
        {dbl('SUM(' + exact('Volume_cm') + ')')} AS cm3,
        {dbl('SUM(' + exact('price') + ')')} AS price_sum
      FROM complete WHERE freight_value IS NOT NULL GROUP BY product_category_name)""")
    durations = """durations AS (
  SELECT date_diff('day', CAST(o.order_purchase_timestamp AS DATE), CAST(i.shipping_limit_date AS DATE)) AS duration_days
  FROM order_items i JOIN seller_orders o ON i.order_id = o.order_id
  WHERE i.shipping_limit_date IS NOT NULL AND o.order_purchase_timestamp IS NOT NULL),
hist AS (SELECT duration_days, COUNT(*) AS items FROM durations GROUP BY duration_days),
cum AS (SELECT duration_days, items,
          CAST(SUM(items) OVER (ORDER BY duration_days ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum,
          CAST(SUM(items) OVER () AS BIGINT) AS n FROM hist)"""
    q["stage_duration_distribution"] = _with(
        f"SELECT duration_days, items, {ratio('cum', 'n')} AS cum_share FROM cum", durations)
    q["stage_duration_summary"] = _with(f"""
SELECT MAX(n) AS n, {ratio('SUM(duration_days * items)', 'MAX(n)')} AS mean_days,
  MIN(CASE WHEN cum >= CEIL(n * 0.5) THEN duration_days END) AS p50_days,
  MIN(CASE WHEN cum >= CEIL(n * 0.9) THEN duration_days END) AS p90_days,
  MIN(CASE WHEN cum >= CEIL(n * 0.99) THEN duration_days END) AS p99_days
FROM cum""", durations)
    q["delay_severity"] = _with("""
SELECT b.delay_bin, COUNT(*) AS orders FROM binned x LEFT JOIN bins b ON x.d_idx = b.d_idx
GROUP BY x.d_idx, b.delay_bin""", _heatmap_ctes(""))
    p_cols = ", ".join(f'"{lab}"' for lab in pct_labels())
    q["stage_heatmaps"] = _with(
        f"SELECT 'Site_Real_PCT' AS stage, delay_bin, pct_bin, orders FROM (SELECT delay_bin, {p_cols} FROM heat) "
        f"UNPIVOT (orders FOR pct_bin IN ({p_cols}))", _heatmap_ctes(""))
    for name, key in (("state_success_rates", "customer_state AS state"),
                      ("monthly_success_rates", "strftime(order_purchase_timestamp, '%Y-%m') AS month")):
        alias = key.split(" AS ")[1]
        q[name] = _with(f"""
SELECT {alias}, orders, delivered, not_delivered, on_time_delivered,
  {ratio('delivered', 'orders', '100', 'CAST(0 AS DOUBLE)')} AS delivery_rate,
  {ratio('on_time_delivered', 'delivered', '100', 'CAST(0 AS DOUBLE)')} AS on_time_rate
FROM (SELECT {key}, COUNT(*) AS orders,
        COUNT(*) FILTER (WHERE Net_State = 'Delivered') AS delivered,
        COUNT(*) FILTER (WHERE Net_State = 'Not_Delivered') AS not_delivered,
        COUNT(*) FILTER (WHERE Net_State = 'Delivered' AND delay_seconds > 0) AS on_time_delivered
      FROM seller_orders WHERE delay_seconds IS NOT NULL GROUP BY 1) WHERE {alias} IS NOT NULL""")


# written out here, not taken from the code under test
_LATE_BINS = {"Delivered": ([-30, -20, -10, -5, -2, 0], ["-30\u2013-20", "-20\u2013-10", "-10\u2013-5", "-5\u2013-2", "-2\u20130"]),
              "Not_Delivered": ([-35, -28, -7.5, -1], ["-35\u2013-28", "-28\u2013-7.5", "-7.5\u2013-1"])}
_PCT_LABELS = ["0\u201310 %", "10\u201320 %", "20\u201330 %", "30\u201340 %", "40\u201350 %", "50\u201360 %", "60\u201370 %",
               "70\u201380 %", "80\u201390 %", "90\u2013100 %"]
_STAGE_ROWS = """
stage_orders AS (
  SELECT order_id, Net_State, delay_seconds, delay_days, Site_Real_PCT,
    CASE WHEN order_id % 103 = 0 THEN NULL ELSE CAST((order_id * 17) % 1301 - 100 AS DOUBLE) / 10.0E0 END AS Carrier_Real_PCT,
    CAST((order_id * 43) % 1001 AS DOUBLE) / 10.0E0 AS Client_Real_PCT,
    CASE WHEN order_id % 71 = 0 THEN NULL ELSE (order_id * 7919) % 200003 + 17 END AS approved,
    CASE WHEN order_id % 67 = 0 THEN NULL ELSE (order_id * 104729) % 900001 - 5000 END AS carrier,
    CASE WHEN Net_State IS NULL OR Net_State = 'Not_Delivered' THEN NULL
         ELSE (order_id * 15485863) % 4000037 + 86400 END AS delivered
  FROM timed WHERE order_purchase_timestamp IS NOT NULL)"""
_REPEATED_ORDERS = """
repeated_orders AS (
  SELECT * FROM seller_orders UNION ALL
  SELECT * REPLACE (CASE WHEN order_id % 106 = 0 THEN order_purchase_timestamp
                         ELSE order_purchase_timestamp + INTERVAL 1 DAY END AS order_purchase_timestamp)
  FROM seller_orders WHERE order_id % 53 = 0)"""
_REPEATED_PRODUCTS = """
more_products AS (
  SELECT * FROM products UNION ALL
  SELECT * REPLACE ('Second' AS product_category_name, NULL AS product_weight_g) FROM products WHERE product_id % 29 = 0 UNION ALL
  SELECT * REPLACE (NULL AS product_id, 'No id ' || product_id AS product_category_name) FROM products WHERE product_id <= 2),
fanned AS (
  SELECT oi.*, COALESCE(p.product_category_name, 'Others') AS product_category_name, p.product_weight_g,
    oi.price + oi.freight_value AS Total
  FROM order_items oi LEFT JOIN more_products p ON oi.product_id IS NOT DISTINCT FROM p.product_id)"""


def _more(q: dict[str, str]) -> None:
    q["delay_text_forms"] = _with("""
SELECT order_id, CASE WHEN order_id % 11 IN (8, 9) THEN NULL ELSE CAST(delay_seconds AS BIGINT) * 1000000000 END AS delay_ns
FROM seller_orders""")
    q["stage_seconds_quantiles"] = _with(f"""
SELECT stage, COUNT(*) AS n, {ratio('SUM(seconds)', 'COUNT(*)')} AS mean_seconds,
  MIN(seconds) FILTER (WHERE r >= CEIL(n * 0.5)) AS p50_seconds, MIN(seconds) FILTER (WHERE r >= CEIL(n * 0.9)) AS p90_seconds,
  MIN(seconds) FILTER (WHERE r >= CEIL(n * 0.99)) AS p99_seconds
FROM (SELECT stage, CAST(seconds AS BIGINT) AS seconds, ROW_NUMBER() OVER (PARTITION BY stage ORDER BY seconds) AS r,
             COUNT(*) OVER (PARTITION BY stage) AS n FROM (
  SELECT 'approval' AS stage, approved AS seconds FROM stage_orders UNION ALL
  SELECT 'handling', carrier - approved FROM stage_orders UNION ALL
  SELECT 'delivery', delivered - carrier FROM stage_orders) WHERE seconds IS NOT NULL) GROUP BY stage""", _STAGE_ROWS)
    edges, labels = _LATE_BINS["Delivered"]
    place = _bin_case("CAST(delay_days AS DOUBLE)", edges)
    bins = ", ".join(f"({i}, '{label}')" for i, label in enumerate(labels))
    pcts = ", ".join(f"({i}, '{label}')" for i, label in enumerate(_PCT_LABELS))
    q["stage_heatmaps_all"] = _with("""
SELECT g.stage, g.delay_bin, g.pct_bin, COUNT(x.d) AS orders
FROM (SELECT stage, d, delay_bin, p, pct_bin FROM (SELECT DISTINCT stage FROM late) CROSS JOIN (
        SELECT d, delay_bin FROM bins UNION ALL SELECT NULL, NULL WHERE EXISTS (SELECT 1 FROM late WHERE d IS NULL)) CROSS JOIN pcts) g
LEFT JOIN (SELECT stage, COALESCE(d, -1) AS d, p FROM late) x ON x.stage = g.stage AND x.d = COALESCE(g.d, -1) AND x.p = g.p
GROUP BY g.stage, g.d, g.delay_bin, g.p, g.pct_bin""", _STAGE_ROWS + f""",
bins(d, delay_bin) AS (VALUES {bins}), pcts(p, pct_bin) AS (VALUES {pcts}),
late AS (""" + " UNION ALL ".join(
        f"SELECT '{c}' AS stage, {place} AS d, {_bin_case(c, [10.0 * i for i in range(11)])} AS p FROM stage_orders WHERE delay_seconds < 0"
        for c in ("Site_Real_PCT", "Carrier_Real_PCT", "Client_Real_PCT")) + ")")
    parts = []
    for name, (edges, labels) in _LATE_BINS.items():
        values = ", ".join(f"({i}, '{label}')" for i, label in enumerate(labels))
        parts.append(f"""
SELECT '{name}' AS range_set, delay_bin, SUM(one)::BIGINT AS orders FROM (
  SELECT {_bin_case("CAST(delay_days AS DOUBLE)", edges)} AS d, 1 AS one FROM timed WHERE delay_seconds < 0 AND Net_State = '{name}'
  UNION ALL SELECT d, 0 FROM (VALUES {values}) b(d, x)) LEFT JOIN (VALUES {values}) c(d, delay_bin) USING (d) GROUP BY d, delay_bin""")
    q["delay_bins_by_range_set"] = _with(" UNION ALL ".join(parts))
    q["success_rate_levels"] = _with(f"""
SELECT level, state, month, orders, delivered, not_delivered, on_time_delivered,
  {ratio('delivered', 'orders', '100', 'CAST(0 AS DOUBLE)')} AS delivery_rate,
  {ratio('on_time_delivered', 'delivered', '100', 'CAST(0 AS DOUBLE)')} AS on_time_rate
FROM (SELECT CASE GROUPING(state, month) WHEN 0 THEN 'state_month' WHEN 1 THEN 'state' WHEN 2 THEN 'month' ELSE 'all' END AS level,
        state, month, COUNT(*) AS orders, COUNT(*) FILTER (WHERE Net_State = 'Delivered') AS delivered,
        COUNT(*) FILTER (WHERE Net_State = 'Not_Delivered') AS not_delivered,
        COUNT(*) FILTER (WHERE Net_State = 'Delivered' AND delay_seconds > 0) AS on_time_delivered
      FROM (SELECT customer_state AS state, strftime(order_purchase_timestamp, '%Y-%m') AS month, * FROM seller_orders
            WHERE delay_seconds IS NOT NULL)
      GROUP BY GROUPING SETS ((state, month), (state), (month), ()))""")
    q["order_items_fan_out"] = _with("SELECT order_id, order_item_id, product_id, product_category_name, product_weight_g, Total "
                                     "FROM fanned", _REPEATED_PRODUCTS)
    q["vendor_revenue_fan_out"] = _with(f"SELECT seller_id, {money('Total')} AS Total FROM fanned "
                                        "WHERE seller_id IS NOT NULL GROUP BY seller_id", _REPEATED_PRODUCTS)
    q["geo_orders_repeated"] = _geo("orders", "", "repeated_orders", _REPEATED_ORDERS + ",\n")
    q["geo_delayed_repeated"] = _geo("orders", "AND delay_seconds < 0", "repeated_orders", _REPEATED_ORDERS + ",\n")
    q["daily_trend_repeated"] = _with("""
SELECT date, orders, AVG(orders) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS orders_roll
FROM daily""", _REPEATED_ORDERS + """,
daily AS (SELECT CAST(order_purchase_timestamp AS DATE) AS date, COUNT(DISTINCT order_id) AS orders
  FROM repeated_orders WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1)""")
    q["orders_by_state_bitmaps"] = _with("""
SELECT customer_state AS state, COUNT(DISTINCT order_id) AS orders,
  COUNT(DISTINCT order_id) FILTER (WHERE delay_seconds < 0) AS delayed,
  COUNT(DISTINCT order_id) FILTER (WHERE Net_State = 'Delivered') AS delivered
FROM repeated_orders WHERE customer_state IS NOT NULL GROUP BY customer_state""", _REPEATED_ORDERS)
    q["daily_orders_bitmaps"] = _with("""
SELECT CAST(order_purchase_timestamp AS DATE) AS date, COUNT(DISTINCT order_id) AS orders
FROM repeated_orders WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1""", _REPEATED_ORDERS)
    q["order_items_co_located"] = q["order_items_fan_out"]
    q["vendor_totals_from_parts"] = f"""
SELECT l_suppkey AS seller_id, COUNT(*) AS items, {dbl('SUM(' + exact('l_extendedprice') + ')')} AS price
FROM lineitem GROUP BY l_suppkey"""
    q["vendor_revenue_ranked"] = _with("SELECT seller_id, Total, position FROM ranked", _ranked_cte("seller_id"))
    q["daily_trend_ranked"] = _with("""
SELECT date, orders, AVG(orders) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS orders_roll,
  ROW_NUMBER() OVER (ORDER BY date) AS place FROM daily""", """daily AS (SELECT CAST(order_purchase_timestamp AS DATE) AS date,
  COUNT(DISTINCT order_id) AS orders FROM seller_orders WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1)""")
