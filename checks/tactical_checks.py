"""Queries for the month-to-date dashboard, planning and the board."""

from pyspark.sql import functions as F

from checks.core_checks import CLIENTS_CTE, DIMS_CTE, GAPS_CTE
from checks import dashboard_checks as dash
from checks.dashboard_checks import pct
from checks.fixtures import CUR, MONTH, MONTH_PREV, MTD, MTD_PREV, MTD_YEAR_AGO, PERIOD, Checks, with_fact
from ventara.functions.rows import literal_rows
from ventara.operators import board, tactical as ops
from ventara.operators import core, focus, history, opportunity
from ventara.plans.session import kept

C = Checks()


def _sum(measure, window):
    return f"CAST(coalesce(sum({measure}) FILTER ({window}), 0) AS DOUBLE)"


TOT_CTE = f"""tot AS (SELECT *, {pct('sales', 'previous_sales')} AS sales_vs_previous_pct, {pct('units', 'previous_units')} AS units_vs_previous_pct,
    {pct('sales', 'year_ago_sales')} AS sales_vs_year_ago_pct, {pct('units', 'year_ago_units')} AS units_vs_year_ago_pct FROM (
  SELECT {_sum('amount', MTD)} AS sales, {_sum('quantity', MTD)} AS units, {_sum('amount', MTD_PREV)} AS previous_sales, {_sum('quantity', MTD_PREV)} AS previous_units,
    {_sum('amount', MTD_YEAR_AGO)} AS year_ago_sales, {_sum('quantity', MTD_YEAR_AGO)} AS year_ago_units FROM fact))"""
DRV_CTE = """drv AS (SELECT 'Mes anterior completo' AS driver, CAST(sum(amount) AS DOUBLE) AS sales, CAST(sum(quantity) AS DOUBLE) AS units FROM fact WHERE period = '2001-06' HAVING count(*) > 0
    UNION ALL SELECT 'Mismo mes año anterior', CAST(sum(amount) AS DOUBLE), CAST(sum(quantity) AS DOUBLE) FROM fact WHERE period = '2000-07' HAVING count(*) > 0
    UNION ALL SELECT 'Promedio móvil 3M', CAST(sum(amount) AS DOUBLE) / count(DISTINCT period), CAST(sum(quantity) AS DOUBLE) / count(DISTINCT period) FROM fact
      WHERE period IN ('2001-04', '2001-05', '2001-06') HAVING count(*) > 0)"""
OBJ_CTE = "obj AS (SELECT median(sales) AS objective_sales, median(units) AS objective_units FROM drv)"
PACE_CTE = """pace AS (SELECT t.*, o.objective_sales AS objective_sales_close, o.objective_units AS objective_units_close, o.objective_sales * (20.0::DOUBLE / 31) AS objective_sales,
    o.objective_units * (20.0::DOUBLE / 31) AS objective_units, sales / 20 * 31 AS projected_sales, units / 20 * 31 AS projected_units FROM tot t, obj o)"""
FLAGS_CTE = f"""flags AS (SELECT client_canonical, bool_or({MTD}) AS c, bool_or({MTD_PREV}) AS p, bool_or({MONTH_PREV}) AS f, bool_or(date < DATE '2001-07-01') AS h FROM fact
    WHERE date <= DATE '2001-07-20' GROUP BY 1),
  move AS (SELECT count(*) FILTER (c) AS active, count(*) FILTER (p) AS previous_active, count(*) FILTER (f AND NOT c) AS without_purchase, count(*) FILTER (p AND NOT c) AS dropped,
    count(*) FILTER (c AND h AND NOT f) AS recovered, count(*) FILTER (c AND NOT h) AS new FROM flags)"""
SUM_CTE = f"""msum AS (SELECT sales, units, objective_sales, objective_units, objective_sales_close, objective_units_close, projected_sales, projected_units,
    {pct('sales', 'objective_sales')} AS sales_vs_objective_pct, {pct('units', 'objective_units')} AS units_vs_objective_pct, sales_vs_previous_pct, sales_vs_year_ago_pct,
    units_vs_previous_pct, units_vs_year_ago_pct, active AS active_clients, without_purchase, dropped, recovered, new AS new_clients, sales / greatest(active, 1) AS ticket_per_client,
    units / greatest(active, 1) AS units_per_client, orders, orders / greatest(active, 1) AS frequency, {pct('projected_sales', 'objective_sales_close')} AS projected_gap_pct,
    sales / 20 AS sales_per_day, units / 20 AS units_per_day, greatest(objective_sales_close - sales, 0) / 11 AS required_sales_per_day,
    greatest(objective_units_close - units, 0) / 11 AS required_units_per_day, CAST(11 AS BIGINT) AS remaining_days
  FROM pace, move, (SELECT count(DISTINCT invoice) AS orders FROM fact WHERE {MTD}))"""
_DIMS = {"seller_name": "seller_name", "route_description": "route_l", "channel": "channel", "supplier": "supplier", "family": "family_l"}
DVP_CTE = "dvp AS (SELECT dimension, label, sales, previous_sales, quantity, clients, previous_clients, orders, " + pct("sales", "previous_sales") + f""" AS growth_pct,
    clients - previous_clients AS client_delta, sales / greatest((SELECT sales FROM tot), 1) * 100 AS share_pct FROM (""" + " UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, {c} AS label, {_sum('amount', MTD)} AS sales, {_sum('amount', MTD_PREV)} AS previous_sales, {_sum('quantity', MTD)} AS quantity,
      count(DISTINCT client_canonical) FILTER ({MTD}) AS clients, count(DISTINCT client_canonical) FILTER ({MTD_PREV}) AS previous_clients, count(DISTINCT invoice) FILTER ({MTD}) AS orders
    FROM fact WHERE ({MTD}) OR ({MTD_PREV}) GROUP BY 2""" for d, c in _DIMS.items()) + "))"
LOST_CTE = f"""lost AS (SELECT rank, client_canonical AS client_id, CAST(v AS DOUBLE) AS sales FROM (SELECT client_canonical, sum(amount) AS v,
    row_number() OVER (ORDER BY sum(amount) DESC, client_canonical) AS rank FROM fact WHERE {MONTH_PREV} GROUP BY 1) WHERE rank <= 50
    AND client_canonical NOT IN (SELECT client_canonical FROM fact WHERE {MTD}))"""
MONTH_BASE = (TOT_CTE, DRV_CTE, OBJ_CTE, PACE_CTE, FLAGS_CTE, SUM_CTE)
MONTH_ALL = (*MONTH_BASE, DVP_CTE, LOST_CTE)


@C.add("mtd_totals", with_fact("SELECT * FROM tot", TOT_CTE))
def mtd_totals(fact):
    return ops.month_totals(fact, MONTH)


@C.add("objective_drivers", with_fact("SELECT * FROM drv", DRV_CTE))
def objective_drivers(fact):
    return ops.objective_drivers(fact, MONTH)


@C.add("objective", with_fact("SELECT * FROM obj", DRV_CTE, OBJ_CTE))
def objective(fact):
    return ops.objective(fact, MONTH)


@C.add("pace", with_fact("SELECT * FROM pace", TOT_CTE, DRV_CTE, OBJ_CTE, PACE_CTE))
def pace(fact):
    return ops.pace(fact, MONTH)


@C.add("sensitivity", with_fact(
    f"""SELECT *, CASE WHEN round(gap_pct, 1) >= 2 THEN 'good' WHEN round(gap_pct, 1) >= -3 THEN 'warn' ELSE 'bad' END AS tone FROM (
      SELECT scenario, pace_pct, projected_sales, projected_units, sales_per_day, units_per_day, required_sales_per_day, required_units_per_day,
        {pct('projected_sales', 'objective_sales_close')} AS gap_pct FROM (
        SELECT scenario, pace_pct, sales + sales / 20 * k * 11 AS projected_sales, units + units / 20 * k * 11 AS projected_units, sales / 20 * k AS sales_per_day, units / 20 * k AS units_per_day,
          greatest(objective_sales_close - sales, 0) / 11 AS required_sales_per_day, greatest(objective_units_close - units, 0) / 11 AS required_units_per_day, objective_sales_close
        FROM pace, (SELECT s AS scenario, p AS pace_pct, 1 + p / 100 AS k FROM (VALUES ('Conservador', -12.0::DOUBLE), ('Ajuste leve', -5.0::DOUBLE), ('Ritmo actual', 0.0::DOUBLE),
          ('Recuperación', 8.0::DOUBLE), ('Aceleración', 15.0::DOUBLE)) v(s, p))))""", TOT_CTE, DRV_CTE, OBJ_CTE, PACE_CTE))
def sensitivity(fact):
    return ops.sensitivity(fact, MONTH)


@C.add("client_movement", with_fact("SELECT * FROM move", FLAGS_CTE))
def client_movement(fact):
    return ops.client_movement(fact, MONTH)


@C.add("dim_vs_previous", with_fact("SELECT * FROM dvp", TOT_CTE, DVP_CTE))
def dim_vs_previous(fact):
    return ops.dimensions_vs_previous(fact, MONTH)


def _cmode(field):
    return f"""(SELECT client_canonical, v FROM (SELECT client_canonical, {field} AS v, count(*) AS n FROM fact WHERE {MTD} GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY client_canonical ORDER BY n DESC, v) = 1)"""


MC_CTE = f"""mc AS (SELECT s.client_canonical AS client_id, client, sales, quantity, orders, sales / greatest(orders, 1) AS avg_ticket, quantity / greatest(orders, 1) AS avg_units_per_order, families,
    CAST(last_date AS VARCHAR) AS last_date, e.v AS seller, r.v AS route, f.v AS sales_force, previous_sales, {pct('sales', 'previous_sales')} AS sales_delta_pct,
    sales / greatest((SELECT sales FROM tot), 1) * 100 AS share_pct, CASE WHEN NOT g.h THEN 'Nuevo' WHEN NOT g.f THEN 'Recuperado' ELSE 'Activo' END AS status, history_sales
  FROM (SELECT client_canonical, arg_max(client, date) AS client, {_sum('amount', MTD)} AS sales, {_sum('quantity', MTD)} AS quantity, {_sum('amount', MTD_PREV)} AS previous_sales,
      {_sum('amount', "date < DATE '2001-07-01'")} AS history_sales, count(DISTINCT invoice) FILTER ({MTD}) AS orders, count(DISTINCT family) FILTER ({MTD}) AS families,
      max(date) FILTER ({MTD}) AS last_date FROM fact WHERE date <= DATE '2001-07-20' GROUP BY 1) s
  JOIN flags g USING (client_canonical) JOIN {_cmode('seller_name')} e USING (client_canonical) JOIN {_cmode('route_l')} r USING (client_canonical)
  JOIN {_cmode('sales_force')} f USING (client_canonical) WHERE g.c)"""


@C.add("mtd_clients", with_fact("SELECT * FROM mc", TOT_CTE, FLAGS_CTE, MC_CTE), once=True)
def mtd_clients(fact):
    return ops.month_clients(fact, MONTH)


@C.add("mtd_client_table", with_fact("SELECT * FROM (SELECT *, row_number() OVER (ORDER BY sales DESC, client_id) AS rank FROM mc) WHERE rank <= 50", TOT_CTE, FLAGS_CTE, MC_CTE), once=True)
def mtd_client_table(fact):
    return ops.month_client_table(ops.month_clients(fact, MONTH))


@C.add("executive_table", with_fact(
    """SELECT rank, client, status, sales, quantity AS units, avg_ticket, avg_units_per_order, families, last_date, sales_force, route, seller, share_pct, sales_delta_pct
    FROM (SELECT *, row_number() OVER (ORDER BY sales DESC, client_id) AS rank FROM mc) WHERE rank <= 50""", TOT_CTE, FLAGS_CTE, MC_CTE), once=True)
def executive_table(fact):
    return ops.executive_table(ops.month_clients(fact, MONTH))


_FALLBACK = """SELECT rank, client, status, sales, quantity AS units, {ticket} AS avg_ticket, {units} AS avg_units_per_order, families, last_date, sales_force, route_description AS route, seller_name AS seller,
    CAST(NULL AS DOUBLE) AS share_pct, CAST(NULL AS DOUBLE) AS sales_delta_pct FROM (SELECT *, row_number() OVER (ORDER BY {metric} DESC, client_key) AS rank FROM clients) WHERE rank <= 10""".replace("{ticket}", "avg_ticket").replace("{units}", "avg_units_per_order")


@C.add("executive_fallback_sales", with_fact(_FALLBACK.replace("{metric}", "sales"), GAPS_CTE, CLIENTS_CTE))
def executive_fallback_sales(fact):
    return ops.executive_fallback(core.client_stats(fact, PERIOD))


@C.add("executive_fallback_units", with_fact(_FALLBACK.replace("{metric}", "quantity"), GAPS_CTE, CLIENTS_CTE))
def executive_fallback_units(fact):
    return ops.executive_fallback(core.client_stats(fact, PERIOD), "units")


@C.add("key_accounts_lost", with_fact("SELECT * FROM lost", LOST_CTE))
def key_accounts_lost(fact):
    return ops.lost_key_accounts(fact, MONTH)


@C.add("daily_cumulative", with_fact(
    """SELECT s AS series, CAST(d AS BIGINT) AS day, CAST(coalesce((SELECT sum(amount) FROM fact WHERE date BETWEEN first AND first + CAST(d - 1 AS INT)), 0) AS DOUBLE) AS value
      FROM (VALUES ('current', DATE '2001-07-01'), ('previous', DATE '2001-06-01'), ('year_ago', DATE '2000-07-01')) v(s, first), range(1, 21) t(d)
    UNION ALL SELECT 'objective', CAST(d AS BIGINT), objective_sales * d / 31 FROM obj, range(1, 21) t(d)""", DRV_CTE, OBJ_CTE))
def daily_cumulative(fact):
    return ops.daily_curves(fact, MONTH)


@C.add("mtd_summary", with_fact("SELECT * FROM msum", *MONTH_BASE))
def mtd_summary(fact):
    return ops.month_summary(fact, MONTH)


_CARDS = (
    ("Venta acumulada", "sales", "CASE WHEN sales >= objective_sales THEN 'good' ELSE 'bad' END"),
    ("Proyección cierre", "projected_sales", "CASE WHEN projected_sales >= objective_sales_close THEN 'good' ELSE 'warn' END"),
    ("Vs objetivo", "sales_vs_objective_pct", "CASE WHEN sales >= objective_sales THEN 'good' ELSE 'bad' END"),
    ("Vs mes anterior", "sales_vs_previous_pct", "CASE WHEN sales_vs_previous_pct >= 0 THEN 'good' ELSE 'warn' END"),
    ("Vs año anterior", "sales_vs_year_ago_pct", "CASE WHEN sales_vs_year_ago_pct >= 0 THEN 'good' ELSE 'warn' END"),
    ("Clientes activos", "active_clients", "'neutral'"), ("Clientes recuperados", "recovered", "CASE WHEN recovered >= greatest(dropped, 1) * 0.35 THEN 'good' ELSE 'warn' END"),
    ("Ticket por cliente", "ticket_per_client", "'neutral'"), ("Bultos por cliente", "units_per_client", "'neutral'"),
    ("Bultos vs objetivo", "units_vs_objective_pct", "CASE WHEN units >= objective_units THEN 'good' ELSE 'warn' END"),
)


@C.add("mtd_kpis", with_fact(" UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{n}' AS label, CAST({v} AS DOUBLE) AS value, {t} AS tone FROM msum" for i, (n, v, t) in enumerate(_CARDS, 1)), *MONTH_BASE))
def mtd_kpis(fact):
    return ops.month_kpis(ops.month_summary(fact, MONTH))


def _worst(dim, cond, by="growth_pct"):
    return f"(SELECT CAST({by} AS DOUBLE) AS value, label FROM dvp WHERE dimension = '{dim}' AND {cond} ORDER BY 1, 2 LIMIT 1)"


_LARGE = "greatest(sales, previous_sales) >= (SELECT sales FROM tot) * 0.015"
MALERT_CTE = f"""malerts AS (
  SELECT 1 AS rule, 'ritmo' AS topic, CASE WHEN abs(round(sales_vs_objective_pct, 1)) >= 5 THEN 'critical' ELSE 'warn' END AS severity, sales_vs_objective_pct AS value, NULL AS label
    FROM msum WHERE sales < objective_sales * 0.99::DOUBLE
  UNION ALL SELECT 2, 'clientes caídos', 'warn', dropped, NULL FROM msum WHERE dropped >= 15
  UNION ALL SELECT 3, 'vendedor', 'warn', value, label FROM {_worst('seller_name', 'round(growth_pct, 1) <= -12 AND ' + _LARGE)}
  UNION ALL SELECT 4, 'ruta', 'warn', value, label FROM {_worst('route_description', 'client_delta <= -8', 'client_delta')}
  UNION ALL SELECT 5, 'proveedor', 'warn', value, label FROM {_worst('supplier', 'round(growth_pct, 1) <= -10 AND sales > 0')}
  UNION ALL SELECT 6, 'familia', 'warn', value, label FROM {_worst('family', 'round(growth_pct, 1) <= -10 AND round(share_pct, 1) >= 5')}
  UNION ALL SELECT 7, 'cuentas clave', 'critical', n, NULL FROM (SELECT count(*) AS n FROM lost) WHERE n > 0)"""
RALERT_CTE = f"""ralerts AS (
  SELECT 1 AS rule, 'Dirección' AS role, 'Riesgo de cierre' AS topic, CASE WHEN round(projected_gap_pct, 1) < -8 THEN 'critical' ELSE 'warn' END AS severity, projected_gap_pct AS value, NULL AS label
    FROM msum WHERE round(sales_vs_objective_pct, 1) < -4 OR round(projected_gap_pct, 1) < -3
  UNION ALL SELECT 2, 'Dirección', 'Cierre controlado', 'good', projected_gap_pct, NULL FROM msum WHERE NOT (round(sales_vs_objective_pct, 1) < -4 OR round(projected_gap_pct, 1) < -3)
  UNION ALL SELECT 3, 'Jefatura ventas', 'Vendedor a corregir', 'warn', value, label FROM {_worst('seller_name', 'round(growth_pct, 1) <= -10 AND ' + _LARGE)}
  UNION ALL SELECT 4, 'Supervisión', 'Ruta debilitada', 'warn', value, label FROM {_worst('route_description', 'client_delta <= -6', 'client_delta')}
  UNION ALL SELECT 5, 'Canales', 'Canal con baja rotación', 'warn', value, label FROM {_worst('channel', 'round(growth_pct, 1) <= -8 AND clients >= 20')}
  UNION ALL SELECT 6, 'Trade / Compras', 'Familia en retracción', 'warn', value, label FROM {_worst('family', 'round(growth_pct, 1) <= -8 AND round(share_pct, 1) >= 5')}
  UNION ALL SELECT 7, 'Key accounts', 'Clientes relevantes sin compra', CASE WHEN n >= 20 THEN 'critical' ELSE 'warn' END, n, NULL FROM (SELECT count(*) AS n FROM lost) WHERE n > 0)"""


@C.add("tactical_alerts", with_fact("SELECT CAST(rule AS BIGINT) AS rule, topic, severity, CAST(value AS DOUBLE) AS value, label FROM malerts ORDER BY rule LIMIT 8", *MONTH_ALL, MALERT_CTE), once=True)
def tactical_alerts(fact):
    return ops.month_alerts(fact, MONTH)


@C.add("role_alerts", with_fact("SELECT CAST(rule AS BIGINT) AS rule, role, topic, severity, CAST(value AS DOUBLE) AS value, label FROM ralerts ORDER BY rule LIMIT 6", *MONTH_ALL, RALERT_CTE), once=True)
def role_alerts(fact):
    return ops.role_alerts(fact, MONTH)


# --- planning: targets derived from last year's growth, plus one label that does not sell ------

def _targets(fact):
    base = fact.filter(F.col("year") == 2000).groupBy(F.col("channel").alias("label")).agg((F.count_distinct("client_key") % 9).cast("double").alias("uplift_pct"))
    return base.filter(F.col("label") != "FURNITURE").unionByName(literal_rows(fact.sparkSession, ["label", "uplift_pct"], [("CANAL NUEVO", 12.0)]))


def _owner_targets(fact):
    base = fact.filter(F.col("year") == 2000).groupBy(F.col("seller_name").alias("seller")).agg((F.count_distinct("client_key") % 11 - 3).cast("double").alias("target_pct"))
    return base.filter(F.col("seller") != "NATION_3").unionByName(literal_rows(fact.sparkSession, ["seller", "target_pct"], [("NADIE", 5.0)]))


PLAN_CTE = """targets AS (SELECT channel AS label, CAST(count(DISTINCT client_key) % 9 AS DOUBLE) AS uplift_pct FROM fact WHERE year = 2000 AND channel <> 'FURNITURE' GROUP BY 1 UNION ALL SELECT 'CANAL NUEVO', 12.0),
  plan AS (SELECT *, base_projection * (1 + uplift_pct / 100) AS target_projection, base_projection * (1 + uplift_pct / 100) - base_projection AS incremental_sales FROM (
    SELECT rank, d.label, share_pct, sales, clients, growth_pct, coalesce(uplift_pct, 0) AS uplift_pct, sales / 20 * 31 AS base_projection
    FROM (SELECT *, row_number() OVER (ORDER BY sales DESC, label) AS rank FROM dvp WHERE dimension = 'channel') d LEFT JOIN targets t ON t.label = d.label WHERE rank <= 8)),
  psum AS (SELECT adjusted_objective, base_projection, additional_sales, recovery_gap, simulated_close, {gap} AS gap_pct, additional_sales / greatest(base_projection, 1) * 100 AS weighted_uplift_pct FROM (
    SELECT *, base_projection + additional_sales AS simulated_close FROM (
    SELECT objective_sales_close * (1 + 4.5::DOUBLE / 100) AS adjusted_objective, projected_sales AS base_projection,
      (SELECT CAST(sum(CAST(round(greatest(incremental_sales, 0), 2) AS DECIMAL(28,2))) AS DOUBLE) FROM plan) AS additional_sales, greatest(60 - recovered, 0) AS recovery_gap FROM msum)))""".replace(
    "{gap}", pct("simulated_close", "adjusted_objective"))
OWNER_CTE = f"""otargets AS (SELECT seller_name AS seller, CAST(count(DISTINCT client_key) % 11 - 3 AS DOUBLE) AS target_pct FROM fact WHERE year = 2000 AND seller_name <> 'NATION_3' GROUP BY 1 UNION ALL SELECT 'NADIE', 5.0),
  owners AS (SELECT *, CASE WHEN round(gap_pct, 1) >= 0 THEN 'good' WHEN round(gap_pct, 1) >= -5 THEN 'warn' ELSE 'bad' END AS tone FROM (
    SELECT *, projection - target AS gap, {pct('projection', 'target')} AS gap_pct FROM (SELECT *, projection * (1 + target_pct / 100) AS target FROM (
      SELECT rank, d.label AS seller, sales, clients, growth_pct, share_pct, coalesce(target_pct, 0) AS target_pct, sales / 20 * 31 AS projection
      FROM (SELECT *, row_number() OVER (ORDER BY sales DESC, label) AS rank FROM dvp WHERE dimension = 'seller_name') d LEFT JOIN otargets t ON t.seller = d.label WHERE rank <= 16)))),
  osumm AS (SELECT owners, on_track, at_risk, CAST(p AS DOUBLE) AS projection, CAST(t AS DOUBLE) AS target, CAST(p - t AS DOUBLE) AS gap, {pct('CAST(p AS DOUBLE)', 'CAST(t AS DOUBLE)')} AS gap_pct,
      worst_seller, worst_gap_pct FROM (SELECT count(*) AS owners, count(*) FILTER (round(gap_pct, 1) >= 0) AS on_track, count(*) FILTER (round(gap_pct, 1) < -5) AS at_risk,
      sum(CAST(round(projection, 2) AS DECIMAL(28,2))) AS p, sum(CAST(round(target, 2) AS DECIMAL(28,2))) AS t, arg_min(seller, gap) AS worst_seller, arg_min(gap_pct, gap) AS worst_gap_pct FROM owners))"""


def _dims(fact):
    return ops.dimensions_vs_previous(fact, MONTH)


@C.add("planning", with_fact("SELECT * FROM plan", *MONTH_ALL, PLAN_CTE))
def planning(fact):
    return ops.planning_rows(_dims(fact), _targets(fact), MONTH)


@C.add("planning_summary", with_fact("SELECT * FROM psum", *MONTH_ALL, PLAN_CTE))
def planning_summary(fact):
    return ops.planning_summary(fact, ops.planning_rows(_dims(fact), _targets(fact), MONTH), MONTH, 4.5, 60)


@C.add("planning_alerts", with_fact(
    """SELECT CAST(1 AS BIGINT) AS rule, 'simulación bajo meta' AS topic, CASE WHEN simulated_close >= adjusted_objective * 0.94::DOUBLE THEN 'warn' ELSE 'critical' END AS severity, gap_pct AS value,
      CAST(NULL AS VARCHAR) AS label FROM psum WHERE adjusted_objective > 0 AND simulated_close < adjusted_objective * 0.98::DOUBLE
    UNION ALL SELECT 2, 'recuperación pendiente', 'warn', recovery_gap, NULL FROM psum WHERE recovery_gap > 0""", *MONTH_ALL, PLAN_CTE))
def planning_alerts(fact):
    return ops.planning_alerts(ops.planning_summary(fact, ops.planning_rows(_dims(fact), _targets(fact), MONTH), MONTH, 4.5, 60))


@C.add("owner_tracking", with_fact("SELECT * FROM owners", *MONTH_ALL, OWNER_CTE))
def owner_tracking(fact):
    return ops.owner_tracking(_dims(fact), _owner_targets(fact), MONTH)


@C.add("owner_summary", with_fact("SELECT * FROM osumm", *MONTH_ALL, OWNER_CTE))
def owner_summary(fact):
    return ops.owner_summary(ops.owner_tracking(_dims(fact), _owner_targets(fact), MONTH))


@C.add("owner_alerts", with_fact(
    """SELECT CAST(1 AS BIGINT) AS rule, 'responsables bajo plan' AS topic, CASE WHEN gap <= -50000000 THEN 'critical' ELSE 'warn' END AS severity, gap AS value, CAST(NULL AS VARCHAR) AS label
      FROM osumm WHERE gap < 0
    UNION ALL SELECT 2, 'mayor desvío', 'warn', worst_gap_pct, worst_seller FROM osumm WHERE round(worst_gap_pct, 1) < -8""", *MONTH_ALL, OWNER_CTE))
def owner_alerts(fact):
    return ops.owner_alerts(ops.owner_summary(ops.owner_tracking(_dims(fact), _owner_targets(fact), MONTH)))


# --- board ----------------------------------------------------------------------------------

_ALL = (GAPS_CTE, CLIENTS_CTE, DIMS_CTE, *MONTH_ALL, RALERT_CTE, dash._MS_CTE, dash._MONTHS_CTE, dash._PARETO_CTE, dash._HSUM_CTE, dash._HALERT_CTE, dash._BUDGET_CTE, dash._BM_CTE, dash._BSUM_CTE,
        dash._BALERT_CTE, dash._OPP_CTE, dash._OSUM_CTE, dash._OALERT_CTE, dash._SELLERS_CTE, dash._SSUM_CTE, dash._SALERT_CTE, dash._DASH_CTE, dash._CSUM_CTE, dash._CALERT_CTE, OWNER_CTE)


# The full texts of the alerts, without their figures and labels, in rule order.
_TEXTS = {
    "ralerts": ("Riesgo de cierre El cierre proyectado viene debajo del objetivo mensual.", "Cierre controlado El ritmo actual deja el cierre contra el objetivo del mes.",
                "Vendedor a corregir cae y necesita reencauzar cartera este mes.", "Ruta debilitada perdió clientes activos vs el mes anterior.", "Canal con baja rotación cae con clientes activos.",
                "Familia en retracción pierde share y cae en el tramo mensual.", "Clientes relevantes sin compra cuentas relevantes del mes pasado siguen sin compra este mes."),
    "balerts": ("último mes bajo plan|Gap contra plan El último mes queda debajo del presupuesto.", "acumulado bajo plan|Gap contra plan El acumulado del rango queda por debajo del plan visible."),
    "halerts": ("caída mensual|Señal estructural El último mes cae vs el mes previo.", "dependencia de clientes|Señal estructural El negocio depende de solo 10 clientes.",
                "concentración|Señal estructural El HHI de clientes sugiere concentración alta."),
    "oalerts": ("potencial accionable|Potencial comercial Hay de potencial accionable en las 30 oportunidades priorizadas.", "clientes con oportunidad|Potencial comercial Se acumulan clientes por debajo del benchmark o con mix corto.",
                "canales bajo promedio|Potencial comercial canales muestran venta por cliente por debajo del promedio general."),
    "salerts": ("dependencia|Productividad La venta depende de solo 3 vendedores.", "vendedor en caída|Productividad cae y pierde clientes.", "cartera liviana|Productividad Hay vendedores con cartera liviana o poco desarrollada."),
    "calerts": ("concentración|Cartera La cartera concentra en solo 10 cuentas.", "sin recompra|Cartera Hay clientes del período anterior sin recompra.", "mix corto|Cartera clientes activos compran 1 familia o menos.",
                "cuenta en riesgo|Cartera está en con días sin compra."),
}


def _said(table):
    texts = [t.split("|") if "|" in t else (next(n for n in _ROLE_TITLES if t.startswith(n)), t) for t in _TEXTS[table]]
    whens = lambda f: "CASE topic " + " ".join(f"WHEN '{topic}' THEN {f(i, text)}" for i, (topic, text) in enumerate(texts)) + " END"
    return f"{whens(lambda i, t: i)} AS rule, {whens(lambda i, t: repr(t))} AS said"


_ROLE_TITLES = ("Riesgo de cierre", "Cierre controlado", "Vendedor a corregir", "Ruta debilitada", "Canal con baja rotación", "Familia en retracción", "Clientes relevantes sin compra")


def _board_sql():
    parts = ["""SELECT role AS area, role AS owner, topic, severity, CASE severity WHEN 'critical' THEN 95 WHEN 'good' THEN 25 ELSE 70 END AS score, CAST(value AS DOUBLE) AS value, label, 0 AS source, """ + _said("ralerts") + " FROM ralerts"]
    tables = (("balerts", "Presupuesto", "Dirección", 92, 72, "NULL"), ("halerts", "Histórico", "Dirección", 90, 66, "NULL"), ("oalerts", "Oportunidad", "Comercial", 86, 62, "NULL"),
              ("salerts", "Vendedores", "Jefatura ventas", 84, 60, "label"), ("calerts", "Clientes", "Key accounts", 88, 64, "label"))
    for i, (t, area, owner, hi, lo, label) in enumerate(tables, 1):
        parts.append(f"SELECT '{area}', '{owner}', topic, severity, CASE severity WHEN 'critical' THEN {hi} ELSE {lo} END, CAST(value AS DOUBLE), {label}, {i}, {_said(t)} FROM {t}")
    return f"""SELECT rank, area, owner, topic, severity, CAST(score AS BIGINT) AS score, value, label, CASE severity WHEN 'critical' THEN 'Alta' ELSE 'Media' END AS priority,
      CASE WHEN t LIKE '%cierre%' OR t LIKE '%objetivo%' THEN 'plan de cierre' WHEN t LIKE '%presupuesto%' OR t LIKE '%plan%' THEN 'ajuste de presupuesto'
        WHEN t LIKE '%cliente%' THEN 'recuperación de cartera' WHEN t LIKE '%canal%' THEN 'cobertura de canal' WHEN t LIKE '%vendedor%' THEN 'meta del responsable' ELSE 'acción correctiva' END AS action
      FROM (SELECT *, lower(concat_ws(' ', area, said, label)) AS t, row_number() OVER (ORDER BY score DESC, source, rule) AS rank FROM ({' UNION ALL '.join(parts)}) WHERE severity <> 'good') WHERE rank <= 6"""


def _parts(fact):
    hist, cur = dash._hist(fact), fact.filter(PERIOD.in_selected())
    clients = kept(core.client_stats(fact, PERIOD))
    dashboard = kept(focus.clients_dashboard(fact, PERIOD, clients))
    return {
        "budget": history.budget_summary(history.budget_monthly(hist, dash.budget_of(fact))), "history": history.history_summary(hist, cur),
        "opportunities": opportunity.opportunities_summary(dash._opps(fact, clients)), "clients": focus.clients_summary(fact, PERIOD, dashboard),
    }, clients, dashboard


# What the board reads of the sales grain.
_BOARD_GRAIN = {"labels": ("seller_name", "sales_force", "route_description", "family", "channel", "supplier"), "identities": (*core.REPORT_IDENTITIES, "client_name", "client_canonical", "year")}


@C.add("direction_board", with_fact(_board_sql(), *_ALL), once=_BOARD_GRAIN)
def direction_board(fact):
    sums, clients, dashboard = _parts(fact)
    alerts = {
        "budget": history.budget_alerts(sums["budget"]), "history": history.history_alerts(sums["history"]),
        "opportunities": opportunity.opportunities_alerts(sums["opportunities"]), "sellers": focus.sellers_alerts(focus.sellers_dashboard(fact, PERIOD)),
        "clients": focus.clients_alerts(sums["clients"], dashboard, clients),
    }
    return board.direction_board(ops.role_alerts(fact, MONTH), alerts)


@C.add("board_kpis", with_fact(
    """SELECT CAST(p AS BIGINT) AS position, label, CAST(value AS DOUBLE) AS value, tone FROM (
      SELECT 1 AS p, 'Gap cierre mes' AS label, projected_gap_pct AS value, CASE WHEN round(projected_gap_pct, 1) >= 0 THEN 'good' WHEN round(projected_gap_pct, 1) >= -3 THEN 'warn' ELSE 'bad' END AS tone FROM msum
      UNION ALL SELECT 2, 'Gap presupuesto', last_gap_pct, CASE WHEN round(last_gap_pct, 1) >= 0 THEN 'good' ELSE 'warn' END FROM bsum
      UNION ALL SELECT 3, 'Gap responsables', gap_pct, CASE WHEN round(gap_pct, 1) >= 0 THEN 'good' ELSE 'warn' END FROM osumm
      UNION ALL SELECT 4, 'Potencial accionable', total_potential, 'good' FROM osum
      UNION ALL SELECT 5, 'Clientes en riesgo', at_risk, CASE WHEN at_risk > 120 THEN 'bad' WHEN at_risk > 60 THEN 'warn' ELSE 'good' END FROM csum
      UNION ALL SELECT 6, 'Concentración top 10', top10_clients_pct, CASE WHEN round(top10_clients_pct, 1) < 30 THEN 'good' WHEN round(top10_clients_pct, 1) < 40 THEN 'warn' ELSE 'bad' END FROM hsum)""", *_ALL), once=_BOARD_GRAIN)
def board_kpis(fact):
    sums, _, _ = _parts(fact)
    owners = ops.owner_summary(ops.owner_tracking(_dims(fact), _owner_targets(fact), MONTH))
    return board.board_kpis(ops.month_summary(fact, MONTH), sums["budget"], owners, sums["opportunities"], sums["clients"], sums["history"])
