"""Queries for the core aggregates."""

from pyspark.sql import functions as F

from checks.fixtures import CUR, PERIOD, PREV, SEEN, Checks, with_fact
from ventara.operators import core

C = Checks()

GAPS_CTE = f"""gaps AS (
  SELECT client_key, coalesce(median(gap), 45) AS gap, max(date) AS last_date FROM (
    SELECT client_key, date, date_diff('day', lag(date) OVER (PARTITION BY client_key ORDER BY date), date) AS gap
    FROM (SELECT DISTINCT client_key, date FROM fact WHERE {SEEN})) GROUP BY client_key)"""

STATUS_CASE = """CASE WHEN recency <= greatest(30, gap * 1.2) THEN 'Activo' WHEN recency <= greatest(60, gap * 2) THEN 'Dormido'
       WHEN recency <= greatest(120, gap * 3) THEN 'Reactivable' ELSE 'Perdido' END"""


def _mode(field, missing):
    return f"""(SELECT client_key, v FROM (SELECT client_key, coalesce({field}, '{missing}') AS v, count(*) AS n FROM fact GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY client_key ORDER BY n DESC, v) = 1)"""


CLIENTS_CTE = f"""client_sums AS (
  SELECT client_key, arg_max(client, date) AS client,
    CAST(coalesce(sum(amount) FILTER ({CUR}), 0) AS DOUBLE) AS sales,
    CAST(coalesce(sum(amount) FILTER ({PREV}), 0) AS DOUBLE) AS previous_sales,
    CAST(sum(amount) AS DOUBLE) AS history_sales,
    CAST(coalesce(sum(quantity) FILTER ({CUR}), 0) AS DOUBLE) AS quantity,
    CAST(coalesce(sum(quantity) FILTER ({PREV}), 0) AS DOUBLE) AS previous_quantity,
    CAST(sum(quantity) AS DOUBLE) AS history_quantity,
    count(DISTINCT period) FILTER ({CUR}) AS months_active,
    count(DISTINCT invoice) FILTER ({CUR}) AS oc, count(DISTINCT invoice) AS oa,
    count(DISTINCT family) FILTER ({CUR}) AS fc, count(DISTINCT family) AS fa, count(*) FILTER ({CUR}) AS nc
  FROM fact WHERE {SEEN} GROUP BY client_key),
clients AS (
  SELECT s.client_key, client, sales, previous_sales, history_sales, quantity, previous_quantity, history_quantity,
    months_active,
    CASE WHEN nc > 0 THEN sales ELSE history_sales END / greatest(CASE WHEN nc > 0 THEN oc ELSE oa END, 1) AS avg_ticket,
    quantity / greatest(CASE WHEN nc > 0 THEN oc ELSE oa END, 1) AS avg_units_per_order,
    CASE WHEN nc > 0 THEN oc ELSE oa END AS orders, CASE WHEN nc > 0 THEN fc ELSE fa END AS families,
    CAST(last_date AS VARCHAR) AS last_date, recency AS recency_days, gap AS avg_gap_days, {STATUS_CASE} AS status,
    f.v AS sales_force, r.v AS route_description, e.v AS seller_name
  FROM client_sums s JOIN (SELECT *, date_diff('day', last_date, DATE '2001-07-31') AS recency FROM gaps) g USING (client_key)
  JOIN {_mode('sales_force', 'Sin fuerza de ventas')} f USING (client_key)
  JOIN {_mode('route_description', 'Sin ruta')} r USING (client_key)
  JOIN {_mode('seller_name', 'Sin vendedor')} e USING (client_key))"""

DIMS_SQL = {
    "seller_name": "seller_name", "sales_force": "sales_force", "family": "family_l", "brand": "brand_l",
    "business_unit": "bu_l", "channel": "channel", "route_description": "route_l",
}
DIMS_CTE = "dims AS (" + " UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, {c} AS label,
      CAST(coalesce(sum(amount) FILTER ({CUR}), 0) AS DOUBLE) AS sales,
      CAST(coalesce(sum(amount) FILTER ({PREV}), 0) AS DOUBLE) AS previous_sales,
      count(DISTINCT client_key) FILTER ({CUR}) AS clients,
      count(DISTINCT CAST(date AS VARCHAR) || client_key || '|' || invoice) FILTER ({CUR}) AS orders,
      CAST(coalesce(sum(quantity) FILTER ({CUR}), 0) AS DOUBLE) AS quantity
    FROM fact GROUP BY 2"""
    for d, c in DIMS_SQL.items()
) + """),
dimension_stats AS (SELECT *, sales / greatest(orders, 1) AS avg_order_value, quantity / greatest(orders, 1) AS avg_units_per_order,
    sales / greatest(clients, 1) AS avg_sales_per_client,
    CASE WHEN previous_sales = 0 THEN CASE WHEN sales > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END
         ELSE (sales - previous_sales) / previous_sales * 100 END AS growth_pct FROM dims)"""


@C.add("client_stats", with_fact("SELECT * FROM clients", GAPS_CTE, CLIENTS_CTE))
def client_stats(fact):
    return core.client_stats(fact, PERIOD)


@C.add("client_status_counts", with_fact("SELECT status, count(*) AS clients FROM clients GROUP BY status", GAPS_CTE, CLIENTS_CTE))
def client_status_counts(fact):
    return core.client_stats(fact, PERIOD).groupBy("status").agg(F.count("*").alias("clients"))


@C.add("dimension_stats", with_fact("SELECT * FROM dimension_stats", DIMS_CTE))
def dimension_stats(fact):
    return core.dimension_stats(fact, PERIOD)


@C.add("usual_seller", with_fact(f"SELECT client_key, v AS seller_name FROM {_mode('seller_name', 'Sin vendedor')}"))
def usual_seller(fact):
    return core.most_common(fact, ["client_key"], "seller_name")


@C.add("orders_index", with_fact(
    "SELECT CAST(date AS VARCHAR) AS date, client_key, invoice, CAST(sum(amount) AS DOUBLE) AS amount, "
    "CAST(sum(quantity) AS DOUBLE) AS quantity FROM fact GROUP BY ALL"))
def orders_index(fact):
    return core.orders_index(fact)


@C.add("concentration", with_fact(
    """SELECT dimension, sum(sales) FILTER (rn <= 3) / greatest(sum(sales), 1) * 100 AS share_pct FROM (
      SELECT dimension, sales, row_number() OVER (PARTITION BY dimension ORDER BY sales DESC) AS rn FROM dimension_stats)
    GROUP BY dimension""", DIMS_CTE), rounded=("share_pct",))
def concentration(fact):
    return core.concentration_share(core.dimension_stats(fact, PERIOD), 3, by=["dimension"])


@C.add("concentration_clients", with_fact(
    """SELECT sum(sales) FILTER (rn <= 10) / greatest(sum(sales), 1) * 100 AS share_pct FROM (
      SELECT sales, row_number() OVER (ORDER BY sales DESC) AS rn FROM clients)""", GAPS_CTE, CLIENTS_CTE), rounded=("share_pct",))
def concentration_clients(fact):
    return core.concentration_share(core.client_stats(fact, PERIOD), 10)


@C.add("real_items", with_fact(
    "SELECT dimension, count(*) FILTER (label <> '' AND lower(label) NOT LIKE 'sin %') AS items FROM dimension_stats GROUP BY 1", DIMS_CTE))
def real_items(fact):
    return core.real_item_counts(core.dimension_stats(fact, PERIOD))


@C.add("monthly_totals", with_fact(
    "SELECT period, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(quantity) AS DOUBLE) AS quantity FROM fact GROUP BY period"))
def monthly_totals(fact):
    return core.monthly_totals(fact)


@C.add("monthly_activity", with_fact(
    """SELECT period, count(DISTINCT client_key) AS clients, count(DISTINCT invoice) AS orders,
      CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(quantity) AS DOUBLE) AS quantity FROM fact GROUP BY period"""))
def monthly_activity(fact):
    return core.monthly_activity(fact)
