"""Queries for the report blocks."""

from checks.core_checks import CLIENTS_CTE, DIMS_CTE, GAPS_CTE
from checks.fixtures import CUR, PERIOD, PREV, SUPPLIER, Checks, table, with_fact
from pyspark.sql import functions as F
from ventara.functions.text import clean
from ventara.operators import report as ops

C = Checks()

COV_CTE = f"""cov AS (SELECT count(route_description) / greatest(count(*), 1) * 100 AS route_pct, count(sales_force) / greatest(count(*), 1) * 100 AS sales_force_pct,
    count(*) FILTER (has_article_match) / greatest(count(*), 1) * 100 AS article_pct, count(*) FILTER (has_seller_match) / greatest(count(*), 1) * 100 AS seller_pct,
    CAST(coalesce(sum(amount) FILTER (route_description IS NULL), 0) AS DOUBLE) AS sales_without_route,
    CAST(coalesce(sum(amount) FILTER (NOT has_article_match), 0) AS DOUBLE) AS sales_without_article,
    CAST(coalesce(sum(amount) FILTER (seller_name IS NULL), 0) AS DOUBLE) AS sales_without_seller,
    CAST(sum(amount) AS DOUBLE) AS sales_total FROM fact WHERE {CUR})"""

TOTALS_CTE = f"""totals AS (SELECT CAST(sum(amount) FILTER ({CUR}) AS DOUBLE) AS sales, CAST(sum(amount) FILTER ({PREV}) AS DOUBLE) AS previous_sales,
    CAST(sum(quantity) FILTER ({CUR}) AS DOUBLE) AS units, CAST(sum(quantity) FILTER ({PREV}) AS DOUBLE) AS previous_units,
    count(DISTINCT CAST(date AS VARCHAR) || '|' || client_key || '|' || invoice) FILTER ({CUR}) AS orders, count(DISTINCT client_key) FILTER ({CUR}) AS buyers FROM fact)"""

CT_CTE = """ct AS (SELECT count(*) AS n, count(*) FILTER (status = 'Activo') AS active, count(*) FILTER (status = 'Dormido') AS dormant,
    count(*) FILTER (status = 'Reactivable') AS reactivable, count(*) FILTER (status = 'Perdido') AS lost, count(*) FILTER (months_active >= 4) AS recurring,
    sum(round(avg_ticket, 2)) AS tickets, CAST(sum(families) AS BIGINT) AS families, CAST(sum(greatest(families, 1)) AS BIGINT) AS families1,
    CAST(sum(CAST(sales AS DECIMAL(28,4))) AS DOUBLE) AS sales, CAST(sum(CAST(history_sales AS DECIMAL(28,4))) FILTER (status IN ('Dormido', 'Reactivable')) AS DOUBLE) AS at_risk,
    count(*) FILTER (status = 'Activo' AND families <= 1) AS low,
    (SELECT sum(sales) FROM (SELECT sales FROM clients ORDER BY sales DESC LIMIT 10)) / greatest(sum(sales), 1) * 100 AS top10 FROM clients)"""

DT_CTE = """dt AS (SELECT dimension, count(*) FILTER (lower(label) NOT LIKE 'sin %' AND label <> '') AS real, count(*) FILTER (sales > 0) AS selling, max(sales) AS best,
    sum(sales) FILTER (rn <= 3) / greatest(sum(sales), 1) * 100 AS top3, sum(sales) FILTER (rn <= 1) / greatest(sum(sales), 1) * 100 AS top1
    FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY sales DESC, label) AS rn FROM dimension_stats) GROUP BY dimension)"""


def _d(name, field):
    return f"(SELECT {field} FROM dt WHERE dimension = '{name}')"


BASE = (GAPS_CTE, CLIENTS_CTE, DIMS_CTE, COV_CTE, TOTALS_CTE, CT_CTE, DT_CTE)

SUMMARY_SQL = f"""SELECT units > 0 OR previous_units > 0 AS volume_mode, CAST(92 AS BIGINT) AS period_days, CAST(3 AS BIGINT) AS period_months,
  t.sales, previous_sales, (t.sales - previous_sales) / previous_sales * 100 AS sales_growth_pct, units, previous_units,
  (units - previous_units) / previous_units * 100 AS units_growth_pct, orders, orders / 3 AS orders_per_month, t.sales / greatest(orders, 1) AS avg_order_value,
  t.sales / greatest(units, 1) AS avg_unit_price, units / greatest(orders, 1) AS avg_units_per_order, active AS active_clients, buyers AS buying_clients,
  active / n * 100 AS active_pct, orders / 3 / greatest(buyers, 1) AS frequency_monthly, orders / 3 / n AS frequency_universe_monthly,
  dormant AS dormant_clients, reactivable AS reactivable_clients, lost AS lost_clients, recurring AS recurring_clients, recurring / n * 100 AS recurring_pct,
  tickets / n AS avg_ticket, families / n AS avg_families_per_client, top10 AS top10_share_pct,
  {_d('seller_name', 'real')} AS seller_count, {_d('sales_force', 'real')} AS sales_force_count, {_d('route_description', 'real')} AS route_count,
  {_d('family', 'real')} AS family_count, {_d('brand', 'real')} AS brand_count, {_d('business_unit', 'real')} AS business_unit_count, {_d('channel', 'real')} AS channel_count,
  t.sales / {_d('seller_name', 'real')} AS sales_per_seller, units / {_d('seller_name', 'real')} AS units_per_seller,
  {_d('brand', 'top1')} AS top_brand_pct, {_d('business_unit', 'top1')} AS top_business_unit_pct, {_d('channel', 'top1')} AS top_channel_pct,
  (active + reactivable * 0.5::DOUBLE) / n * 100 AS portfolio_health_pct, route_pct, article_pct, seller_pct FROM totals t, ct, cov"""

RATIOS_SQL = f"""SELECT units > 0 AS volume_mode, t.sales / n AS sales_per_client, t.sales / buyers AS sales_per_buyer, t.sales / {_d('seller_name', 'real')} AS sales_per_seller,
  units / n AS units_per_client, units / buyers AS units_per_buyer, units / {_d('seller_name', 'real')} AS units_per_seller, n / {_d('seller_name', 'real')} AS clients_per_seller,
  orders / {_d('seller_name', 'real')} AS orders_per_seller, orders AS total_orders, CAST(3 AS BIGINT) AS period_months, n AS total_clients, orders / 3 AS orders_per_month,
  orders / 3 / buyers AS frequency_monthly, orders / 3 / n AS frequency_universe_monthly, buyers AS buying_clients, buyers / n * 100 AS buying_pct,
  t.sales / orders AS avg_order_value, units / orders AS avg_units_per_order, t.sales / units AS avg_unit_price,
  {_d('sales_force', 'top3')} AS top3_forces_pct, {_d('seller_name', 'top3')} AS top3_sellers_pct, top10 AS top10_clients_pct,
  {_d('brand', 'top1')} AS top_brand_pct, {_d('business_unit', 'top1')} AS top_business_unit_pct, {_d('channel', 'top1')} AS top_channel_pct,
  families / n AS families_per_client, families / buyers AS families_per_buyer, dormant AS dormant_clients, reactivable AS reactivable_clients, lost AS lost_clients,
  recurring AS recurring_clients, dormant / n * 100 AS dormant_pct, reactivable / n * 100 AS reactivable_pct, lost / n * 100 AS lost_pct, recurring / n * 100 AS recurring_pct,
  (t.sales - sales_without_article - sales_without_route) / greatest(t.sales, 1) * 100 AS mapped_sales_pct,
  100 - route_pct AS route_leakage_pct, 100 - article_pct AS article_leakage_pct, 100 - seller_pct AS seller_leakage_pct FROM totals t, ct, cov"""

FORECAST_CTE = """fc AS (SELECT t.*, sales * (1 + greatest(least(trend_pct, 20), -20) * 0.6::DOUBLE / 100) AS projected_sales,
    units * (1 + greatest(least(units_trend_pct, 20), -20) * 0.6::DOUBLE / 100) AS projected_units FROM (
    SELECT sales, units, (sales - previous_sales) / previous_sales * 100 AS trend_pct, (units - previous_units) / previous_units * 100 AS units_trend_pct FROM totals) t)"""

OPP_CTE = f"""opp AS (SELECT *, recover_dormant + cross_sell + route_optimization + family_push AS total_potential FROM (
    SELECT at_risk * 0.15::DOUBLE AS recover_dormant, CAST(low AS DOUBLE) * (sales / greatest(families1, 1)) * 0.12::DOUBLE AS cross_sell,
      sales_without_route * 0.08::DOUBLE AS route_optimization, {_d('family', 'best')} * 0.06::DOUBLE AS family_push, low AS low_breadth_clients,
      {_d('route_description', 'selling')} AS routes_tracked FROM ct, cov))"""

SUMMARY_CTE = f"summary AS ({SUMMARY_SQL})"

ALERTS_CTE = f"""alerts AS (SELECT CAST(rule AS BIGINT) AS rule, topic, severity, CAST(value AS DOUBLE) AS value, label FROM (
    SELECT 1 AS rule, 'rutas' AS topic, 'high' AS severity, route_pct AS value, CAST(NULL AS VARCHAR) AS label, round(route_pct, 1) < 85 AS fires FROM summary
    UNION ALL SELECT 2, 'articulos', 'medium', article_pct, NULL, round(article_pct, 1) < 85 FROM summary
    UNION ALL SELECT 3, 'cartera', 'high', top10_share_pct, NULL, round(top10_share_pct, 1) >= 55 FROM summary
    UNION ALL SELECT 4, 'surtido', 'medium', low, NULL, low >= 10 FROM ct
    UNION ALL SELECT 5, 'vendedores', 'medium', top3, NULL, top3 >= 60 FROM dt WHERE dimension = 'seller_name'
    UNION ALL SELECT 6, 'familia', 'medium', growth_pct, label, TRUE FROM (SELECT growth_pct, label FROM dimension_stats
        WHERE dimension = 'family' AND round(growth_pct, 1) <= -15 ORDER BY growth_pct, label LIMIT 1)
    UNION ALL SELECT 7, 'fuerzas', 'medium', top3, NULL, top3 >= 60 FROM dt WHERE dimension = 'sales_force'
    UNION ALL SELECT 8, 'marca', 'medium', top1, NULL, top1 >= 45 FROM dt WHERE dimension = 'brand'
    UNION ALL SELECT 9, 'canal', 'medium', top1, NULL, top1 >= 55 FROM dt WHERE dimension = 'channel') WHERE fires ORDER BY rule LIMIT 8)"""


def _base(fact):
    return ops.report_base(fact, PERIOD, keep=True)


@C.add("coverage", with_fact("SELECT * FROM cov", COV_CTE))
def coverage(fact):
    return ops.coverage(fact.filter(PERIOD.in_selected()))


@C.add("period_totals", with_fact("SELECT * FROM totals", TOTALS_CTE))
def period_totals(fact):
    return ops.period_totals(fact, PERIOD)


@C.add("summary", with_fact(SUMMARY_SQL, *BASE), rounded=("avg_ticket", "top10_share_pct", "top_channel_pct", "top_brand_pct", "top_business_unit_pct",))
def summary(fact):
    return ops.summary(_base(fact))


@C.add("ratios", with_fact(RATIOS_SQL, *BASE), rounded=("top10_clients_pct", "top_channel_pct", "top_brand_pct", "top_business_unit_pct", "top3_forces_pct", "top3_sellers_pct",))
def ratios(fact):
    return ops.ratios(_base(fact))


@C.add("supplier_months", with_fact(
    f"""SELECT m.period, count(DISTINCT client_key) FILTER (supplier = '{SUPPLIER}') AS supplier_clients, count(DISTINCT client_key) AS active_clients,
      (SELECT count(DISTINCT client_key) FROM fact WHERE {CUR}) AS period_clients,
      count(DISTINCT client_key) FILTER (supplier = '{SUPPLIER}') / greatest(count(DISTINCT client_key), 1) * 100 AS coverage_pct
    FROM (VALUES ('2001-05'), ('2001-06'), ('2001-07')) m(period) LEFT JOIN (SELECT * FROM fact WHERE {CUR}) f USING (period) GROUP BY 1"""))
def supplier_months(fact):
    return ops.supplier_months(fact, PERIOD, SUPPLIER)


@C.add("supplier_focus", with_fact(
    f"""SELECT '{SUPPLIER}' AS supplier, s.*, a.active_clients, b.avg_active_clients, units / greatest(period_clients, 1) AS units_per_client,
      sales / greatest(period_clients, 1) AS sales_per_client, a.supplier_clients / greatest(a.active_clients, 1) * 100 AS coverage_pct, a.supplier_clients,
      sales / greatest(total, 1) * 100 AS mix_pct, sales / greatest(orders, 1) AS ticket, '2001-07' AS last_month, '2001-06' AS previous_month,
      CASE WHEN previous_month_sales = 0 THEN CASE WHEN last_month_sales > 0 THEN 100 ELSE 0 END ELSE (last_month_sales - previous_month_sales) / previous_month_sales * 100 END AS growth_pct
    FROM (SELECT CAST(coalesce(sum(amount) FILTER (mine), 0) AS DOUBLE) AS sales, CAST(coalesce(sum(quantity) FILTER (mine), 0) AS DOUBLE) AS units,
        count(DISTINCT client_key) FILTER (mine) AS clients, count(DISTINCT CAST(date AS VARCHAR) || client_key || '|' || invoice) FILTER (mine) AS orders,
        count(DISTINCT client_key) AS period_clients, CAST(coalesce(sum(amount) FILTER (mine AND period = '2001-07'), 0) AS DOUBLE) AS last_month_sales,
        CAST(coalesce(sum(amount) FILTER (mine AND period = '2001-06'), 0) AS DOUBLE) AS previous_month_sales
      FROM (SELECT *, supplier = '{SUPPLIER}' AS mine FROM fact WHERE {CUR})) s,
    (SELECT CAST(sum(amount) AS DOUBLE) AS total FROM fact WHERE {CUR}),
    (SELECT count(DISTINCT client_key) AS active_clients, count(DISTINCT client_key) FILTER (supplier = '{SUPPLIER}') AS supplier_clients FROM fact WHERE period = '2001-07' AND {CUR}) a,
    (SELECT CAST(sum(n) AS DOUBLE) / count(*) AS avg_active_clients FROM (SELECT count(DISTINCT client_key) AS n FROM fact WHERE {CUR} GROUP BY period)) b"""))
def supplier_focus(fact):
    return ops.supplier_focus(fact, PERIOD, SUPPLIER)


@C.add("forecast", with_fact(
    f"""SELECT period, 'real' AS kind, CAST(sum(amount) AS DOUBLE) AS sales, CAST(sum(quantity) AS DOUBLE) AS units FROM fact WHERE {CUR} GROUP BY period
    UNION ALL SELECT p, 'proyección', projected_sales / 3, projected_units / 3 FROM fc, (VALUES ('2001-08'), ('2001-09'), ('2001-10')) v(p)""", TOTALS_CTE, FORECAST_CTE))
def forecast(fact):
    return ops.forecast(fact, PERIOD)


@C.add("forecast_summary", with_fact(
    "SELECT sales / 3 AS base_sales, units / 3 AS base_units, trend_pct, units_trend_pct, units > 0 AS volume_mode, projected_sales, projected_units FROM fc", TOTALS_CTE, FORECAST_CTE))
def forecast_summary(fact):
    return ops.forecast_summary(fact, PERIOD)


@C.add("opportunity_totals", with_fact("SELECT * FROM opp", *BASE, OPP_CTE))
def opportunity_totals(fact):
    return ops.opportunity_totals(_base(fact))


@C.add("alerts", with_fact("SELECT * FROM alerts", *BASE, SUMMARY_CTE, ALERTS_CTE))
def alerts(fact):
    return ops.alerts(_base(fact))


def _light(v, lo, hi):
    return f"CASE WHEN round({v}, 1) >= {hi} THEN 'green' WHEN round({v}, 1) >= {lo} THEN 'yellow' ELSE 'red' END"


@C.add("semaphores", with_fact(" UNION ALL ".join(
    f"SELECT '{n}' AS name, {v} AS value, {_light(v, lo, hi)} AS color FROM {t}" for n, v, lo, hi, t in (
        ("Evolución del período", "CASE WHEN volume_mode THEN units_growth_pct ELSE sales_growth_pct END", 0, 8, "summary"),
        ("Calidad de cartera", "portfolio_health_pct", 65, 80, "summary"), ("Cobertura de rutas", "route_pct", 85, 95, "summary"),
        ("Cobertura de artículos", "article_pct", 85, 95, "summary"), ("Cobertura de vendedores", "seller_pct", 80, 95, "summary"),
        ("Proyección", "CASE WHEN units > 0 THEN units_trend_pct ELSE trend_pct END", 0, 8, "fc"))), *BASE, SUMMARY_CTE, FORECAST_CTE))
def semaphores(fact):
    return ops.semaphores(_base(fact))


def _lists_sql(lists, n):
    union = " UNION ALL ".join(f"SELECT '{name}' AS list, label, {m} AS value FROM dimension_stats WHERE dimension = '{d}'" for name, d, m in lists)
    return f"SELECT list, rank, label, value FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY value DESC, label) AS rank FROM ({union})) WHERE rank <= {n}"


@C.add("top_items", with_fact(_lists_sql(ops.ITEM_LISTS, 8), DIMS_CTE))
def top_items(fact):
    return ops.top_items(_base(fact).dimensions)


_CLIENT_LISTS = " UNION ALL ".join(
    f"SELECT '{n}' AS list, rank, client AS label, {v} AS value FROM (SELECT *, row_number() OVER (ORDER BY {o}, client_key) AS rank FROM clients) WHERE rank <= 10" for n, v, o in (
        ("clientes_importe", "sales", "sales DESC"), ("clientes_unidades", "quantity", "quantity DESC"),
        ("clientes_riesgo", "history_sales", "CASE status WHEN 'Perdido' THEN 0 WHEN 'Reactivable' THEN 1 WHEN 'Dormido' THEN 2 ELSE 3 END, history_sales DESC")))


@C.add("rankings", with_fact(_lists_sql(ops.RANKING_LISTS, 10) + " UNION ALL " + _CLIENT_LISTS, GAPS_CTE, CLIENTS_CTE, DIMS_CTE))
def rankings(fact):
    base = _base(fact)
    return ops.rankings(base.clients, base.dimensions)


def _series_sql(dims, metrics, n):
    cols = {"seller_name": "seller_name", "brand": "brand_l", "channel": "channel", "family": "family_l", "line": "line_l", "business_unit": "bu_l",
            "supplier": "supplier", "sales_scheme_name": "sales_scheme_name", "sales_force": "sales_force", "route_description": "route_l"}
    union = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, '{m}' AS metric, {cols[d]} AS label, period, CAST(sum({m}) AS DECIMAL(38,6)) AS v FROM fact WHERE {CUR} GROUP BY 3, 4" for d in dims for m in metrics)
    return f"""SELECT * FROM (WITH s AS ({union}), r AS (SELECT dimension, metric, label, sum(v) AS total,
        row_number() OVER (PARTITION BY dimension, metric ORDER BY sum(v) DESC, label) AS rank FROM s GROUP BY 1, 2, 3)
      SELECT r.dimension, r.metric, r.rank, r.label, CAST(r.total AS DOUBLE) AS total, m.period, CAST(coalesce(s.v, 0) AS DOUBLE) AS value
      FROM r CROSS JOIN (VALUES ('2001-05'), ('2001-06'), ('2001-07')) m(period)
      LEFT JOIN s ON s.dimension = r.dimension AND s.metric = r.metric AND s.label = r.label AND s.period = m.period WHERE r.rank <= {n})"""


@C.add("monthly_series", with_fact(_series_sql(("seller_name", "brand", "channel"), ("amount", "quantity"), 8)))
def monthly_series(fact):
    return ops.monthly_series(fact.filter(PERIOD.in_selected()), PERIOD.labels)


@C.add("interactive_cube", with_fact(_series_sql(ops.CUBE_DIMENSIONS, ops.CUBE_METRICS, 12)))
def interactive_cube(fact):
    return ops.interactive_cube(fact.filter(PERIOD.in_selected()), PERIOD.labels)


@C.add("cube_totals", with_fact(" UNION ALL ".join(
    f"SELECT period, '{m}' AS metric, CAST(sum({m}) AS DOUBLE) AS value FROM fact WHERE {CUR} GROUP BY period" for m in ops.CUBE_METRICS)))
def cube_totals(fact):
    return ops.cube_totals(fact.filter(PERIOD.in_selected()), PERIOD.labels)


@C.add("report_triggers", with_fact(
    """SELECT CAST(rule AS BIGINT) AS rule, kind, topic, CAST(value AS DOUBLE) AS value FROM (
      SELECT 1 AS rule, 'insight' AS kind, 'evolución' AS topic, units_growth_pct AS value, TRUE AS fires FROM summary
      UNION ALL SELECT 2, 'insight', 'productividad', units_per_seller, TRUE FROM summary UNION ALL SELECT 3, 'insight', 'mix', top_brand_pct, TRUE FROM summary
      UNION ALL SELECT 4, 'insight', 'calidad de datos', route_pct, TRUE FROM summary UNION ALL SELECT 5, 'insight', 'proyección', projected_units, TRUE FROM fc
      UNION ALL SELECT 6, 'insight', 'palancas', recover_dormant, TRUE FROM opp UNION ALL SELECT 7, 'acción', 'recuperar cartera', recover_dormant, round(recover_dormant, 2) > 0 FROM opp
      UNION ALL SELECT 8, 'acción', 'profundizar surtido', cross_sell, round(cross_sell, 2) > 0 FROM opp
      UNION ALL SELECT 9, 'acción', 'depurar rutas', sales_without_route, round(route_pct, 1) < 95 FROM cov
      UNION ALL SELECT 10, 'acción', 'completar artículos', sales_without_article, round(article_pct, 1) < 95 FROM cov
      UNION ALL SELECT 11, 'acción', 'revisar proyección', projected_sales, TRUE FROM fc
      UNION ALL SELECT 12, 'acción', 'atender alerta', count(*), count(*) > 0 FROM alerts) WHERE fires""", *BASE, SUMMARY_CTE, FORECAST_CTE, OPP_CTE, ALERTS_CTE), rounded=("value",))
def report_triggers(fact):
    return ops.report_triggers(_base(fact))


@C.add("dataset_meta", """SELECT 'sales' AS dataset, CAST(year(o_orderdate) AS VARCHAR) AS source, count(*) AS rows_read,
    count(*) FILTER (l_returnflag <> 'R') AS rows_valid FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2
  UNION ALL SELECT 'articles', 'part', count(*), count(*) FILTER (p_brand <> '') FROM part""", on_fact=False)
def dataset_meta(spark, sf_dir):
    sales = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("sales").alias("dataset"), F.year("o_orderdate").cast("string").alias("source"), (F.col("l_returnflag") != "R").alias("is_valid"))
    articles = table(spark, sf_dir, "part").select(F.lit("articles").alias("dataset"), F.lit("part").alias("source"), (clean("p_brand") != "").alias("is_valid"))
    return ops.dataset_meta(sales.unionByName(articles))
