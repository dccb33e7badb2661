"""Queries for consistency, sellers, clients, history, budget and opportunities."""

from datetime import date

from pyspark.sql import functions as F

from checks.core_checks import CLIENTS_CTE, DIMS_CTE, GAPS_CTE
from checks.fixtures import CUR, PERIOD, PREV, SEEN, Checks, with_fact
from ventara.functions.rows import literal_rows
from ventara.operators import consistency, core, focus, history, opportunity
from ventara.plans.period import slice_history
from ventara.plans.session import kept

C = Checks()


def pct(cur, prev):
    return f"CASE WHEN abs({prev}) < 0.0001 THEN CASE WHEN abs({cur}) < 0.0001 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END ELSE ({cur} - {prev}) / abs({prev}) * 100 END"


# --- consistency ----------------------------------------------------------------------------

_CONS_CTE = f"""cons AS (SELECT *, clients / greatest(routes, 1) AS clients_per_route, duplicates / greatest(rows, 1) * 100 AS duplicate_pct, dated_rows / greatest(rows, 1) * 100 AS dated_pct FROM (
  SELECT count(*) AS rows, CAST(sum(a) AS DOUBLE) AS sales, CAST(sum(quantity) AS DOUBLE) AS quantity, count(DISTINCT client_key) AS clients, count(DISTINCT seller_name) AS sellers,
    count(DISTINCT route_description) AS routes, count(DISTINCT product_key) AS products,
    (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM fact WHERE {CUR} GROUP BY fact_key)) AS duplicates,
    count(route_description) / count(*) * 100 AS route_pct, count(seller_name) / count(*) * 100 AS seller_pct, count(*) FILTER (has_article_match) / count(*) * 100 AS article_pct,
    count(channel) / count(*) * 100 AS channel_pct, count(date) AS dated_rows, count(*) FILTER (abs(a) < 0.0001) AS zero_rows, count(*) FILTER (a < 0) AS negative_rows
  FROM (SELECT *, amount * sign AS a FROM fact WHERE {CUR})))"""


def _signed(fact):
    return fact.filter(PERIOD.in_selected()).withColumn("amount", (F.col("amount") * F.col("sign")).cast("decimal(18,4)"))


@C.add("consistency_totals", with_fact("SELECT * FROM cons", _CONS_CTE))
def consistency_totals(fact):
    return consistency.consistency_totals(_signed(fact))


def _sev(v, crit, warn):
    return f"CASE WHEN {v} < {crit} THEN 'critical' WHEN {v} < {warn} THEN 'warn' ELSE 'ok' END"


_CHECK_ROWS = f"""checks AS (
  SELECT 1 AS position, 'Duplicados de hechos' AS name, CASE WHEN round(duplicate_pct, 1) > 2 THEN 'critical' WHEN round(duplicate_pct, 1) > 0 THEN 'warn' ELSE 'ok' END AS severity, duplicate_pct AS metric FROM cons
  UNION ALL SELECT 2, 'Cobertura de rutas', {_sev('round(route_pct, 1)', 75, 90)}, route_pct FROM cons
  UNION ALL SELECT 3, 'Cobertura de vendedores', {_sev('round(seller_pct, 1)', 75, 90)}, seller_pct FROM cons
  UNION ALL SELECT 4, 'Cobertura de artículos', {_sev('round(article_pct, 1)', 75, 90)}, article_pct FROM cons
  UNION ALL SELECT 5, 'Cobertura de canal', {_sev('round(channel_pct, 1)', 80, 95)}, channel_pct FROM cons
  UNION ALL SELECT 6, 'Cardinalidad de rutas', {_sev('round(clients_per_route, 2)', 0.75, 2)}, clients_per_route FROM cons
  UNION ALL SELECT 7, 'Filas con importe cero', CASE WHEN zero_rows > 0 THEN 'warn' ELSE 'ok' END, zero_rows FROM cons
  UNION ALL SELECT 8, 'Filas negativas', CASE WHEN negative_rows > 0 THEN 'warn' ELSE 'ok' END, negative_rows FROM cons
  UNION ALL SELECT 9, 'Fechas válidas', CASE WHEN dated_rows = rows THEN 'ok' ELSE 'critical' END, dated_pct FROM cons)"""


@C.add("consistency_checks", with_fact(
    """SELECT (SELECT CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warn' ELSE 'ok' END FROM checks) AS status,
      CAST(position AS BIGINT) AS position, name, severity, CAST(metric AS DOUBLE) AS metric FROM checks""", _CONS_CTE, _CHECK_ROWS))
def consistency_checks(fact):
    return consistency.consistency_checks(consistency.consistency_totals(_signed(fact)))


@C.add("consistency_months", with_fact(f"SELECT period, count(*) AS rows FROM fact WHERE {CUR} GROUP BY period"))
def consistency_months(fact):
    return consistency.consistency_months(fact.filter(PERIOD.in_selected()))


# --- sellers --------------------------------------------------------------------------------

def _seller_mode(field):
    return f"""(SELECT seller_name, v FROM (SELECT seller_name, {field} AS v, {CUR} AS cur, count(*) AS n FROM fact WHERE ({CUR}) OR ({PREV}) GROUP BY 1, 2, 3)
      QUALIFY row_number() OVER (PARTITION BY seller_name ORDER BY cur DESC, n DESC, v) = 1)"""


_SELLERS_CTE = f"""pairs AS (SELECT seller_name, client_canonical, coalesce(sum(amount) FILTER ({CUR}), 0) AS v, bool_or({CUR}) AS c, bool_or({PREV}) AS p FROM fact WHERE ({CUR}) OR ({PREV}) GROUP BY 1, 2),
  moves AS (SELECT seller_name, count(*) FILTER (c) AS clients, count(*) FILTER (p) AS pclients, count(*) FILTER (c AND NOT p) AS rec, count(*) FILTER (p AND NOT c) AS drp FROM pairs GROUP BY 1),
  t3 AS (SELECT seller_name, sum(v) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY seller_name ORDER BY v DESC, client_canonical) AS rn FROM pairs WHERE c) WHERE rn <= 3 GROUP BY 1),
  sellers AS (SELECT s.seller_name AS seller, sales, previous_sales, growth_pct, quantity, clients, clients - pclients AS client_delta, orders, sales / greatest(orders, 1) AS avg_ticket,
      quantity / greatest(orders, 1) AS avg_units_per_order, sales / greatest(clients, 1) AS sales_per_client, sales / greatest(total, 1) * 100 AS share_pct,
      rec AS recovered_clients, drp AS dropped_clients, CAST(coalesce(top3, 0) AS DOUBLE) / greatest(sales, 1) * 100 AS top3_clients_pct, f.v AS sales_force, r.v AS route,
      CASE WHEN round(growth_pct, 1) <= -12 OR clients - pclients <= -6 THEN 'En riesgo' WHEN round(growth_pct, 1) >= 5 AND clients >= pclients THEN 'Sólido' ELSE 'Atento' END AS status
    FROM (SELECT *, {pct('sales', 'previous_sales')} AS growth_pct, (SELECT CAST(sum(amount) AS DOUBLE) FROM fact WHERE {CUR}) AS total FROM (
        SELECT seller_name, CAST(coalesce(sum(amount) FILTER ({CUR}), 0) AS DOUBLE) AS sales, CAST(coalesce(sum(amount) FILTER ({PREV}), 0) AS DOUBLE) AS previous_sales,
          CAST(coalesce(sum(quantity) FILTER ({CUR}), 0) AS DOUBLE) AS quantity, count(DISTINCT invoice) FILTER ({CUR}) AS orders FROM fact WHERE ({CUR}) OR ({PREV}) GROUP BY 1)) s
    JOIN moves USING (seller_name) LEFT JOIN t3 USING (seller_name) JOIN {_seller_mode('sales_force')} f USING (seller_name) JOIN {_seller_mode('route_l')} r USING (seller_name))"""


def _sellers(fact):
    return focus.sellers_dashboard(fact, PERIOD)


@C.add("sellers_dashboard", with_fact("SELECT * FROM sellers", _SELLERS_CTE))
def sellers_dashboard(fact):
    return _sellers(fact)


_SSUM_CTE = """ssum AS (SELECT count(*) AS sellers, sum(sales) / count(*) AS sales_per_seller, sum(quantity) / count(*) AS units_per_seller, CAST(sum(clients) AS DOUBLE) / count(*) AS clients_per_seller,
    (SELECT sum(sales) FROM (SELECT sales FROM sellers ORDER BY sales DESC LIMIT 3)) / sum(sales) * 100 AS top3_pct,
    count(*) FILTER (round(growth_pct, 1) <= -12 AND sales >= (SELECT sum(sales) FROM sellers) * 0.015) AS weak_sellers,
    count(*) FILTER (clients <= 15 AND sales < (SELECT sum(sales) FROM sellers) * 0.01) AS light_portfolios,
    CAST(sum(recovered_clients) AS BIGINT) AS recovered_clients, CAST(sum(dropped_clients) AS BIGINT) AS dropped_clients FROM sellers)"""
_SALERT_CTE = """salerts AS (SELECT 'sellers' AS board, 'warn' AS severity, 'dependencia' AS topic, top3_pct AS value, NULL AS label FROM ssum WHERE round(top3_pct, 1) >= 55
    UNION ALL SELECT 'sellers', 'warn', 'vendedor en caída', growth_pct, seller FROM (SELECT growth_pct, seller FROM sellers
      WHERE round(growth_pct, 1) <= -12 AND sales >= (SELECT sum(sales) FROM sellers) * 0.015 ORDER BY growth_pct, seller LIMIT 1)
    UNION ALL SELECT 'sellers', 'warn', 'cartera liviana', light_portfolios, NULL FROM ssum WHERE light_portfolios > 0)"""


@C.add("sellers_summary", with_fact("SELECT * FROM ssum", _SELLERS_CTE, _SSUM_CTE), rounded=("top3_pct", "sales_per_seller",), once=True)
def sellers_summary(fact):
    return focus.sellers_summary(_sellers(fact))


@C.add("sellers_alerts", with_fact("SELECT * FROM salerts", _SELLERS_CTE, _SSUM_CTE, _SALERT_CTE), once=True)
def sellers_alerts(fact):
    return focus.sellers_alerts(_sellers(fact))


@C.add("sellers_charts", with_fact(" UNION ALL ".join(
    f"SELECT '{n}' AS chart, rank, seller, CAST({m} AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (ORDER BY {m} {d}, seller) AS rank FROM sellers) WHERE rank <= {k}"
    for n, m, d, k in (("venta", "sales", "DESC", 8), ("caídas", "growth_pct", "ASC", 8), ("subas", "growth_pct", "DESC", 4), ("clientes", "clients", "DESC", 8),
                       ("concentración", "top3_clients_pct", "DESC", 8))), _SELLERS_CTE), once=True)
def sellers_charts(fact):
    return focus.sellers_charts(_sellers(fact))


# --- clients --------------------------------------------------------------------------------

_DASH_CTE = f"""dash AS (SELECT client, lower(client) AS client_id,
    CASE WHEN lower(client) IN (SELECT client_canonical FROM fact WHERE {CUR}) AND previous_sales <= 0 THEN CASE WHEN history_sales > sales THEN 'Recuperado' ELSE 'Nuevo' END ELSE status END AS status,
    sales, previous_sales, {pct('sales', 'previous_sales')} AS growth_pct, quantity, sales / greatest(orders, 1) AS avg_ticket, quantity / greatest(orders, 1) AS avg_units_per_order,
    families, last_date, sales_force, route_description AS route, seller_name AS seller, recency_days, sales / greatest((SELECT sum(sales) FROM clients), 1) * 100 AS share_pct FROM clients)"""
_CSUM_CTE = f"""csum AS (SELECT count(*) FILTER (act) AS active, count(*) FILTER (status IN ('Dormido', 'Reactivable', 'Perdido')) AS at_risk, count(*) FILTER (status = 'Recuperado') AS recovered,
    count(*) FILTER (status = 'Nuevo') AS new, (SELECT sum(sales) FROM (SELECT sales FROM dash ORDER BY sales DESC LIMIT 10)) / sum(sales) * 100 AS top10_pct,
    sum(round(avg_ticket, 2)) FILTER (act) / count(*) FILTER (act) AS avg_ticket,
    (SELECT count(*) FROM (SELECT client_canonical FROM fact WHERE {PREV} EXCEPT SELECT client_canonical FROM fact WHERE {CUR})) AS not_repurchased
  FROM (SELECT *, status IN ('Activo', 'Recuperado', 'Nuevo') AND sales > 0 AS act FROM dash))"""
_CALERT_CTE = """calerts AS (SELECT 'clients' AS board, 'warn' AS severity, 'concentración' AS topic, top10_pct AS value, NULL AS label FROM csum WHERE round(top10_pct, 1) >= 45
    UNION ALL SELECT 'clients', 'warn', 'sin recompra', not_repurchased, NULL FROM csum WHERE not_repurchased >= 120
    UNION ALL SELECT 'clients', 'warn', 'mix corto', n, NULL FROM (SELECT count(*) AS n FROM clients WHERE status = 'Activo' AND families <= 1) WHERE n >= 25
    UNION ALL SELECT 'clients', 'critical', 'cuenta en riesgo', recency_days, client FROM (SELECT * FROM dash WHERE status IN ('Dormido', 'Reactivable', 'Perdido') ORDER BY sales DESC, client_id DESC LIMIT 1))"""


# What the client and dimension statistics of the dashboards read of the sales grain.
_CLIENT_GRAIN = {"labels": ("seller_name", "sales_force", "route_description", "family"), "identities": (*core.REPORT_IDENTITIES, "client_canonical")}


def _clients(fact):
    return core.client_stats(fact, PERIOD)


@C.add("clients_lifecycle", with_fact("SELECT * FROM dash", GAPS_CTE, CLIENTS_CTE, _DASH_CTE), rounded=("share_pct",))
def clients_lifecycle(fact):
    return focus.clients_dashboard(fact, PERIOD, _clients(fact))


@C.add("lifecycle_counts", with_fact("SELECT status, count(*) AS clients FROM dash GROUP BY status", GAPS_CTE, CLIENTS_CTE, _DASH_CTE))
def lifecycle_counts(fact):
    return focus.lifecycle_counts(focus.clients_dashboard(fact, PERIOD, _clients(fact)))


@C.add("clients_summary", with_fact("SELECT * FROM csum", GAPS_CTE, CLIENTS_CTE, _DASH_CTE, _CSUM_CTE), rounded=("avg_ticket", "top10_pct",), once=_CLIENT_GRAIN)
def clients_summary(fact):
    return focus.clients_summary(fact, PERIOD, kept(focus.clients_dashboard(fact, PERIOD, kept(_clients(fact)))))


@C.add("clients_alerts", with_fact("SELECT * FROM calerts", GAPS_CTE, CLIENTS_CTE, _DASH_CTE, _CSUM_CTE, _CALERT_CTE), once=_CLIENT_GRAIN)
def clients_alerts(fact):
    clients = kept(_clients(fact))
    dashboard = kept(focus.clients_dashboard(fact, PERIOD, clients))
    return focus.clients_alerts(focus.clients_summary(fact, PERIOD, dashboard), dashboard, clients)


# --- history --------------------------------------------------------------------------------

_MONTHS_CTE = f"""months AS (SELECT m.period, m.sales, m.quantity, m.clients, m.orders,
    avg(m.sales) OVER (ORDER BY m.period ROWS 2 PRECEDING) AS rolling3, avg(m.sales) OVER (ORDER BY m.period ROWS 5 PRECEDING) AS rolling6,
    {pct('m.sales', 'coalesce(lag(m.sales) OVER (ORDER BY m.period), 0)')} AS mom_pct, {pct('m.sales', 'coalesce(y.sales, 0)')} AS yoy_pct
  FROM ms m LEFT JOIN ms y ON y.period = CAST(CAST(substr(m.period, 1, 4) AS INT) - 1 AS VARCHAR) || substr(m.period, 5))"""
_MS_CTE = f"""ms AS (SELECT period, CAST(sum(amount) AS DOUBLE) AS sales, CAST(sum(quantity) AS DOUBLE) AS quantity, count(DISTINCT client_canonical) AS clients, count(DISTINCT invoice) AS orders
    FROM fact WHERE {SEEN} GROUP BY period)"""


def _hist(fact):
    return slice_history(fact, PERIOD.selected_end)


@C.add("monthly_history", with_fact("SELECT * FROM months", _MS_CTE, _MONTHS_CTE), rounded=("rolling3", "rolling6",))
def monthly_history(fact):
    return history.monthly_history(_hist(fact))


@C.add("cohorts", with_fact(
    f"""SELECT p.period, coalesce(count(*) FILTER (c.client IS NOT NULL AND first_no = p.n), 0) AS new, count(*) FILTER (c.client IS NOT NULL AND b.client IS NOT NULL) AS active,
      count(*) FILTER (c.client IS NOT NULL AND b.client IS NULL AND first_no < p.n) AS recovered, count(*) FILTER (c.client IS NULL AND b.client IS NOT NULL) AS lost,
      count(c.client) AS current_clients
    FROM per p CROSS JOIN firsts f LEFT JOIN cm c ON c.client = f.client AND c.n = p.n LEFT JOIN cm b ON b.client = f.client AND b.n = p.n - 1 GROUP BY p.period""",
    f"per AS (SELECT period, row_number() OVER (ORDER BY period) AS n FROM (SELECT DISTINCT period FROM fact WHERE {SEEN}))",
    f"cm AS (SELECT DISTINCT client_canonical AS client, n FROM fact JOIN per USING (period) WHERE {SEEN})",
    "firsts AS (SELECT client, min(n) AS first_no FROM cm GROUP BY client)"))
def cohorts(fact):
    return history.cohorts(_hist(fact))


_PARETO_CTE = f"""pareto AS (SELECT row_number() OVER (ORDER BY v DESC, client) AS rank, client, CAST(v AS DOUBLE) AS sales, CAST(v AS DOUBLE) / greatest(CAST(t AS DOUBLE), 1) * 100 AS share_pct,
    least(CAST(sum(v) OVER (ORDER BY v DESC, client ROWS UNBOUNDED PRECEDING) AS DOUBLE) / greatest(CAST(t AS DOUBLE), 1) * 100, 100) AS cumulative_pct
  FROM (SELECT client, sum(amount) AS v, sum(sum(amount)) OVER () AS t FROM fact WHERE {CUR} GROUP BY client))"""


@C.add("pareto", with_fact("SELECT * FROM pareto", _PARETO_CTE))
def pareto(fact):
    return history.pareto(fact.filter(PERIOD.in_selected()))


@C.add("pareto_top", with_fact("SELECT * FROM pareto WHERE rank <= 20", _PARETO_CTE))
def pareto_top(fact):
    return history.pareto_top(fact.filter(PERIOD.in_selected()))


def _hhi_sql(dims):
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS dimension, sum(s * s) * 10000 AS hhi FROM (SELECT CAST(sum(amount) AS DOUBLE) / greatest(CAST(sum(sum(amount)) OVER () AS DOUBLE), 1) AS s
        FROM fact WHERE {CUR} GROUP BY {d})""" for d in dims)


@C.add("hhi", with_fact(_hhi_sql(("client", "supplier", "seller_name", "channel"))), rounded=("hhi",))
def hhi(fact):
    return history.hhi(fact.filter(PERIOD.in_selected()))


@C.add("mix", with_fact(" UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, rank, label, sales, share_pct FROM (SELECT {c} AS label, CAST(sum(amount) AS DOUBLE) AS sales,
      CAST(sum(amount) AS DOUBLE) / greatest(CAST(sum(sum(amount)) OVER () AS DOUBLE), 1) * 100 AS share_pct, row_number() OVER (ORDER BY sum(amount) DESC, {c}) AS rank
      FROM fact WHERE {CUR} GROUP BY 1) WHERE rank <= 4""" for d, c in (("channel", "channel"), ("supplier", "supplier"), ("family", "family_l")))))
def mix(fact):
    return history.dimension_mix(fact.filter(PERIOD.in_selected()))


_HSUM_CTE = f"""hsum AS (SELECT (SELECT count(*) FROM months) AS months, period AS last_period, sales, quantity, mom_pct, yoy_pct, rolling3, rolling6,
    (SELECT hhi FROM ({_hhi_sql(('client',))})) AS hhi_client, (SELECT cumulative_pct FROM pareto WHERE rank = 10) AS top10_clients_pct,
    (SELECT CAST(sum(v) AS DOUBLE) FROM (SELECT sum(amount) AS v FROM fact WHERE {CUR} GROUP BY supplier ORDER BY v DESC LIMIT 5))
      / (SELECT CAST(sum(amount) AS DOUBLE) FROM fact WHERE {CUR}) * 100 AS top5_suppliers_pct FROM months ORDER BY period DESC LIMIT 1)"""
_HALERT_CTE = """halerts AS (SELECT 'history' AS board, 'warn' AS severity, 'caída mensual' AS topic, mom_pct AS value FROM hsum WHERE round(mom_pct, 1) <= -8
    UNION ALL SELECT 'history', 'warn', 'dependencia de clientes', top10_clients_pct FROM hsum WHERE round(top10_clients_pct, 1) >= 45
    UNION ALL SELECT 'history', 'warn', 'concentración', hhi_client FROM hsum WHERE round(hhi_client, 0) >= 900)"""


@C.add("history_summary", with_fact("SELECT * FROM hsum", _MS_CTE, _MONTHS_CTE, _PARETO_CTE, _HSUM_CTE), rounded=("hhi_client", "rolling3", "rolling6",))
def history_summary(fact):
    return history.history_summary(_hist(fact), fact.filter(PERIOD.in_selected()))


@C.add("history_alerts", with_fact("SELECT * FROM halerts", _MS_CTE, _MONTHS_CTE, _PARETO_CTE, _HSUM_CTE, _HALERT_CTE))
def history_alerts(fact):
    return history.history_alerts(history.history_summary(_hist(fact), fact.filter(PERIOD.in_selected())))


# --- budget ---------------------------------------------------------------------------------

_BUDGET_CTE = f"""budget AS (SELECT CAST(CAST(substr(period, 1, 4) AS INT) + 1 AS VARCHAR) || substr(period, 5) AS period, CAST(sum(amount) * 1.1 AS DECIMAL(18,2)) AS budget
    FROM fact WHERE {SEEN} GROUP BY period)"""
_BM_CTE = f"""bm AS (SELECT period, sales, budget, sales - budget AS gap, {pct('sales', 'budget')} AS gap_pct FROM (
    SELECT m.period, m.sales, CAST(coalesce(b.budget, 0) AS DOUBLE) AS budget FROM ms m LEFT JOIN budget b USING (period)))"""
_BSUM_CTE = f"""bsum AS (SELECT count(*) FILTER (budget > 0) AS months_budgeted, max(period) AS last_period, arg_max(budget, period) AS last_budget, arg_max(gap, period) AS last_gap,
    arg_max(gap_pct, period) AS last_gap_pct, CAST(sum(CAST(budget AS DECIMAL(28,4))) AS DOUBLE) AS total_budget,
    CAST(sum(CAST(sales AS DECIMAL(28,4))) - sum(CAST(budget AS DECIMAL(28,4))) AS DOUBLE) AS total_gap,
    {pct('CAST(sum(CAST(sales AS DECIMAL(28,4))) AS DOUBLE)', 'CAST(sum(CAST(budget AS DECIMAL(28,4))) AS DOUBLE)')} AS total_gap_pct FROM bm)"""
_BALERT_CTE = """balerts AS (SELECT 'budget' AS board, 'warn' AS severity, 'último mes bajo plan' AS topic, last_gap_pct AS value FROM bsum WHERE months_budgeted > 0 AND round(last_gap_pct, 1) <= -6
    UNION ALL SELECT 'budget', 'warn', 'acumulado bajo plan', total_gap FROM bsum WHERE months_budgeted > 0 AND total_gap < 0)"""


def budget_of(fact):
    """Plan: last year's month plus ten percent."""
    year = (F.substring("period", 1, 4).cast("int") + 1).cast("string")
    months = _hist(fact).groupBy(F.concat(year, F.substring("period", 5, 3)).alias("period"))
    return months.agg((F.sum("amount") * F.lit("1.1").cast("decimal(2,1)")).cast("decimal(18,2)").alias("budget"))


def budget_shares(fact):
    """Plan shares: last year's channel mix without one channel, plus a channel that does not sell yet."""
    year = fact.filter(F.col("date").between(F.lit(date(2000, 1, 1)), F.lit(date(2000, 12, 31))))
    total = core.one_row(year, F.sum("amount").alias("t")).t
    mix = year.filter(F.col("channel") != "BUILDING").groupBy(F.col("channel").alias("label")).agg(
        F.round(F.sum("amount").cast("double") / total.cast("double") * 100, 1).alias("share_pct"))
    return mix.unionByName(literal_rows(fact.sparkSession, ["label", "share_pct"], [("CANAL NUEVO", 7.5)]))


_SHARES_CTE = """shares AS (SELECT channel AS label, round(CAST(sum(amount) AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM fact WHERE year = 2000) * 100, 1) AS share_pct
    FROM fact WHERE year = 2000 AND channel <> 'BUILDING' GROUP BY 1 UNION ALL SELECT 'CANAL NUEVO', 7.5)"""


@C.add("budget_monthly", with_fact("SELECT * FROM bm", _MS_CTE, _BUDGET_CTE, _BM_CTE), rounded=("gap",))
def budget_monthly(fact):
    return history.budget_monthly(_hist(fact), budget_of(fact))


@C.add("budget_summary", with_fact("SELECT * FROM bsum", _MS_CTE, _BUDGET_CTE, _BM_CTE, _BSUM_CTE), rounded=("last_gap",))
def budget_summary(fact):
    return history.budget_summary(history.budget_monthly(_hist(fact), budget_of(fact)))


@C.add("budget_alerts", with_fact("SELECT * FROM balerts", _MS_CTE, _BUDGET_CTE, _BM_CTE, _BSUM_CTE, _BALERT_CTE))
def budget_alerts(fact):
    return history.budget_alerts(history.budget_summary(history.budget_monthly(_hist(fact), budget_of(fact))))


@C.add("budget_dimension", with_fact(
    f"""SELECT label, sales, share_pct, budget_share_pct, budget, sales - budget AS gap, {pct('sales', 'budget')} AS gap_pct FROM (
      SELECT coalesce(a.label, s.label) AS label, coalesce(a.v, 0) AS sales, coalesce(a.v, 0) / (SELECT sum(v) FROM act) * 100 AS share_pct, coalesce(s.share_pct, 0) AS budget_share_pct,
        (SELECT CAST(budget AS DOUBLE) FROM budget WHERE period = '2001-07') * coalesce(s.share_pct, 0) / 100 AS budget
      FROM (SELECT * FROM act ORDER BY v DESC LIMIT 12) a FULL JOIN shares s ON s.label = a.label)""",
    _BUDGET_CTE, _SHARES_CTE, "act AS (SELECT channel AS label, CAST(sum(amount) AS DOUBLE) AS v FROM fact WHERE period = '2001-07' GROUP BY 1)"))
def budget_dimension(fact):
    return history.budget_by_dimension(_hist(fact), budget_of(fact), budget_shares(fact), "channel")


@C.add("budget_total", with_fact(
    f"""SELECT 'Total' AS label, sales, 100.0::DOUBLE AS share_pct, 100.0::DOUBLE AS budget_share_pct, budget, gap, gap_pct FROM bm WHERE period = '2001-07'""",
    _MS_CTE, _BUDGET_CTE, _BM_CTE))
def budget_total(fact):
    return history.budget_by_dimension(_hist(fact), budget_of(fact), budget_shares(fact))


# --- opportunities --------------------------------------------------------------------------

_OPP_CTE = f"""bench AS (SELECT sales_force, CAST(sum(CAST(sales AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS b FROM clients WHERE sales > 0 GROUP BY 1),
  cents AS (SELECT *, round(CAST(avg_sales_per_client AS DOUBLE), 2) AS own FROM dimension_stats),
  opps AS (SELECT 'Cliente bajo benchmark' AS type, client AS name, seller_name AS owner, sales_force AS segment, greatest(b - sales, 0) * 0.35::DOUBLE AS potential, families
      FROM clients JOIN bench USING (sales_force) WHERE status = 'Activo' AND b > 0 AND sales < b * 0.6::DOUBLE
    UNION ALL SELECT 'Cliente con mix corto', client, seller_name, sales_force, sales * 0.18::DOUBLE, families FROM clients WHERE status = 'Activo' AND families <= 1 AND sales > 0
    UNION ALL SELECT 'Vendedor con baja productividad', label, '', 'Vendedor', (m - own) * clients * 0.25::DOUBLE, 0 FROM cents,
      (SELECT CAST(sum(CAST(own AS DECIMAL(28,2))) AS DOUBLE) / count(*) AS m FROM cents WHERE dimension = 'seller_name')
      WHERE dimension = 'seller_name' AND label <> 'Sin vendedor' AND sales > 0 AND clients >= 25 AND own < m * 0.65::DOUBLE
    UNION ALL SELECT 'Canal con potencial', label, '', 'Canal', (a - own) * clients * 0.2::DOUBLE, 0 FROM cents,
      (SELECT CAST(sum(amount) AS DOUBLE) / greatest(count(DISTINCT client_canonical), 1) AS a FROM fact WHERE {CUR})
      WHERE dimension = 'channel' AND label <> 'Sin canal' AND clients > 10 AND own < a * 0.75::DOUBLE)"""
_OSUM_CTE = """osum AS (SELECT count(*) AS opportunities, count(*) FILTER (type LIKE 'Cliente%') AS client_opportunities, count(*) FILTER (type = 'Cliente bajo benchmark') AS below_benchmark,
    count(*) FILTER (type = 'Cliente con mix corto') AS short_mix, count(*) FILTER (type LIKE 'Vendedor%') AS seller_opportunities, count(*) FILTER (type LIKE 'Canal%') AS channel_opportunities,
    (SELECT CAST(sum(CAST(round(potential, 2) AS DECIMAL(28,2))) AS DOUBLE) FROM (SELECT potential FROM opps ORDER BY potential DESC LIMIT 30)) AS total_potential FROM opps)"""
_OALERT_CTE = """oalerts AS (SELECT 'opportunities' AS board, 'warn' AS severity, 'potencial accionable' AS topic, total_potential AS value FROM osum WHERE total_potential > 0
    UNION ALL SELECT 'opportunities', 'warn', 'clientes con oportunidad', client_opportunities FROM osum WHERE client_opportunities >= 25
    UNION ALL SELECT 'opportunities', 'warn', 'canales bajo promedio', channel_opportunities FROM osum WHERE channel_opportunities >= 2)"""


def _opps(fact, clients=None):
    fact = fact if "lines" in fact.columns else kept(core.sales_grain(fact, (*_CLIENT_GRAIN["labels"], "channel"), identities=_CLIENT_GRAIN["identities"]))
    return opportunity.all_opportunities(fact, PERIOD, kept(_clients(fact)) if clients is None else clients, kept(core.dimension_stats(fact, PERIOD, ("seller_name", "channel"))))


@C.add("opportunities_all", with_fact("SELECT * FROM opps", GAPS_CTE, CLIENTS_CTE, DIMS_CTE, _OPP_CTE))
def opportunities_all(fact):
    return _opps(fact)


@C.add("opportunities", with_fact(
    "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY potential DESC, type, name) AS rank FROM opps) WHERE rank <= 80", GAPS_CTE, CLIENTS_CTE, DIMS_CTE, _OPP_CTE))
def opportunities(fact):
    return opportunity.prioritised(_opps(fact))


@C.add("opportunities_summary", with_fact("SELECT * FROM osum", GAPS_CTE, CLIENTS_CTE, DIMS_CTE, _OPP_CTE, _OSUM_CTE))
def opportunities_summary(fact):
    return opportunity.opportunities_summary(_opps(fact))


@C.add("opportunities_alerts", with_fact("SELECT * FROM oalerts", GAPS_CTE, CLIENTS_CTE, DIMS_CTE, _OPP_CTE, _OSUM_CTE, _OALERT_CTE))
def opportunities_alerts(fact):
    return opportunity.opportunities_alerts(opportunity.opportunities_summary(_opps(fact)))
