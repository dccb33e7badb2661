"""Queries for indicators, lights and insights."""

from checks import analysis_checks as a
from checks.fixtures import Checks, with_fact
from ventara.operators import signals as ops

C = Checks()

_TREND = """trend AS (SELECT *, last3_avg * 3 * (1 + greatest(least(trend_pct, 20), -20) * 0.6::DOUBLE / 100) AS projected FROM (
    SELECT *, (last3_avg - prev3_avg) / prev3_avg * 100 AS trend_pct FROM (SELECT count(*) AS periods, CAST(sum(value) FILTER (back <= 3) AS DOUBLE) / 3 AS last3_avg,
      CAST(sum(value) FILTER (back BETWEEN 4 AND 6) AS DOUBLE) / 3 AS prev3_avg FROM (SELECT period, sum(amount) AS value, row_number() OVER (ORDER BY period DESC) AS back FROM fact GROUP BY period))))"""
_RANK = """rk AS (SELECT CAST(max(t) AS DOUBLE) AS total, CAST(sum(v) FILTER (rn <= 3) AS DOUBLE) / CAST(max(t) AS DOUBLE) * 100 AS top3_pct,
    sum((CAST(v AS DOUBLE) / CAST(t AS DOUBLE)) * (CAST(v AS DOUBLE) / CAST(t AS DOUBLE))) FILTER (rn <= 20) * 10000 AS hhi_top, max(client) FILTER (rn = 1) AS leader,
    max(CAST(v AS DOUBLE) / CAST(t AS DOUBLE) * 100) FILTER (rn = 1) AS leader_share FROM (
    SELECT client, sum(amount) AS v, sum(sum(amount)) OVER () AS t, row_number() OVER (ORDER BY sum(amount) DESC, client) AS rn FROM fact GROUP BY client))"""
_CHURN = """ch AS (SELECT *, active / total_clients * 100 AS active_pct, recurring / total_clients * 100 AS recurring_pct, (dormant + reactivable + lost) / total_clients * 100 AS churn_pct,
    orders12m / 12 / greatest(buyers12m, 1) AS freq, orders12m / 12 / total_clients AS freq_universe FROM (
    SELECT count(*) AS total_clients, count(*) FILTER (status = 'Activo') AS active, count(*) FILTER (status = 'Dormido') AS dormant, count(*) FILTER (status = 'Reactivable') AS reactivable,
      count(*) FILTER (status = 'Perdido') AS lost, count(*) FILTER (months_active >= 4) AS recurring, sum(orders12) AS orders12m, count(*) FILTER (orders12 > 0) AS buyers12m,
      avg(round(avg_ticket, 2)) AS avg_ticket, CAST(sum(CAST(history_sales AS DECIMAL(28,4))) FILTER (status IN ('Dormido', 'Reactivable')) AS DOUBLE) AS at_risk_sales FROM churn))"""
_BR = """br AS (SELECT CAST(sum(breadth) AS DOUBLE) / count(*) AS avg_breadth, count(*) FILTER (breadth <= 1) AS low, count(*) FILTER (breadth <= 1) / count(*) * 100 AS low_pct FROM breadth)"""
_RT = """rt AS (SELECT CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS total, count(*) AS routes,
    CAST(coalesce(sum(CAST(value AS DECIMAL(28,4))) FILTER (NOT covered), 0) AS DOUBLE) / CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) * 100 AS uncovered_pct FROM route_rows)"""
_MG = """mg AS (SELECT CAST(sum(amount) AS DOUBLE) AS revenue, CAST(sum(amount) - sum(cost) AS DOUBLE) AS margin, CAST(sum(amount) - sum(cost) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) * 100 AS margin_pct FROM fact),
  mi AS (SELECT count(*) FILTER (round(p, 1) < 10) AS low, max(p) AS best, arg_max(label, p) AS best_label FROM (
    SELECT coalesce(brand, '') AS label, CAST(sum(amount) - sum(cost) AS DOUBLE) / greatest(CAST(sum(amount) AS DOUBLE), 1) * 100 AS p FROM fact GROUP BY 1))"""
_CN = "cn AS (SELECT count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS total, arg_max(label, value) AS leader, max(share_pct) AS leader_share FROM channels)"
BASE = (_TREND, _RANK, a.CHURN_CTE, _CHURN, a.BREADTH_CTE, _BR, f"se AS ({a._perf_summary_sql('seller_name')})", f"fo AS ({a._perf_summary_sql('sales_force')})",
        f"pr AS ({a._perf_summary_sql('family')})", a.ROUTES_CTE, _RT, _MG, a.CHANNEL_CTE, _CN)

_KPIS = [
    ("trend_pct", "trend_pct", "trend", "pct", "tiempo", 1), ("base_monthly", "last3_avg", "trend", "money", "tiempo", 1), ("projected_quarter", "projected", "trend", "money", "tiempo", 1),
    ("dim_total", "total", "rk", "money", "cartera", 1), ("top3_share", "top3_pct", "rk", "pct", "cartera", 1), ("hhi", "hhi_top", "rk", "int", "cartera", 1),
    ("total_clients", "total_clients", "ch", "int", "cartera", 1), ("active_pct", "active_pct", "ch", "pct", "cartera", 1), ("recurring_pct", "recurring_pct", "ch", "pct", "cartera", 1),
    ("purchase_frequency_monthly", "freq", "ch", "text", "cartera", 1), ("avg_ticket", "avg_ticket", "ch", "money", "cartera", 1), ("churn_at_risk", "at_risk_sales", "ch", "money", "cartera", 1),
    ("avg_breadth", "avg_breadth", "br", "text", "producto", 2), ("low_breadth_pct", "low_pct", "br", "pct", "producto", 2),
    ("seller_total", "total", "se", "money", "territorio", 1), ("seller_top3_share", "top3_pct", "se", "pct", "territorio", 1), ("seller_count", "labels", "se", "int", "territorio", 1),
    ("geo_total", "total", "rt", "money", "territorio", 2), ("geo_cov_pct", "100 - uncovered_pct", "rt", "pct", "territorio", 2),
    ("total_revenue", "revenue", "mg", "money", "margen", 1), ("total_margin", "margin", "mg", "money", "margen", 1), ("margin_pct", "margin_pct", "mg", "pct", "margen", 1),
    ("force_total", "total", "fo", "money", "territorio", 2), ("force_top3_share", "top3_pct", "fo", "pct", "territorio", 2),
    ("product_total", "total", "pr", "money", "producto", 2), ("product_top3_pct", "top3_pct", "pr", "pct", "producto", 2), ("growing_cats", "growing", "pr", "int", "producto", 2),
    ("channel_total", "total", "cn", "money", "canal", 2), ("top_channel_pct", "leader_share", "cn", "pct", "canal", 2),
]
_DOM = {"tiempo": 0, "cartera": 1, "territorio": 2, "producto": 3, "canal": 4, "margen": 5, "fuerza": 6}


@C.add("kpis", with_fact(" UNION ALL ".join(
    f"""SELECT '{n}' AS id, CAST({v} AS DOUBLE) AS value, '{f}' AS format, {'trend_pct' if n == 'trend_pct' else 'CAST(NULL AS DOUBLE)'} AS delta,
      {"CASE WHEN trend_pct > 0.5 THEN 'up' WHEN trend_pct < -0.5 THEN 'down' ELSE 'flat' END" if n == 'trend_pct' else "'flat'"} AS delta_dir,
      '{d}' AS domain, CAST({p} AS BIGINT) AS priority, CAST({_DOM[d]} AS BIGINT) AS domain_rank, CAST({i} AS BIGINT) AS position FROM {t}"""
    for i, (n, v, t, f, d, p) in enumerate(_KPIS)), *BASE), rounded=("value",))
def kpis(fact):
    return ops.kpis(ops.headlines(fact))


def _light(v, yellow, green, digits=1):
    if yellow > green:
        return f"CASE WHEN round({v}, {digits}) < {green} THEN 'green' WHEN round({v}, {digits}) < {yellow} THEN 'yellow' ELSE 'red' END"
    return f"CASE WHEN round({v}, {digits}) >= {green} THEN 'green' WHEN round({v}, {digits}) >= {yellow} THEN 'yellow' ELSE 'red' END"


@C.add("kpi_lights", with_fact(" UNION ALL ".join(
    f"SELECT '{n}' AS id, CAST({v} AS DOUBLE) AS value, {_light(v, y, g, 2 if n == 'profundidad' else 1)} AS color, CAST({i} AS BIGINT) AS position FROM {t}" for i, (n, v, t, y, g) in enumerate((
        ("crecimiento", "trend_pct", "trend", 0, 8), ("hhi", "hhi_top", "rk", 2500, 1000), ("cartera_activa", "active_pct", "ch", 55, 75), ("recurrencia", "recurring_pct", "ch", 40, 60),
        ("profundidad", "avg_breadth", "br", 2, 3), ("seller_conc", "top3_pct", "se", 70, 50), ("cobertura_ruta", "100 - uncovered_pct", "rt", 80, 92), ("margen", "margin_pct", "mg", 10, 20)))),
    *BASE), rounded=("value",))
def kpi_lights(fact):
    return ops.lights(ops.headlines(fact))


@C.add("kpi_ratios", with_fact(
    """SELECT trend_pct, last3_avg AS base_monthly, rk.top3_pct AS dim_concentration_pct, hhi_top AS hhi, active_pct, recurring_pct, freq AS purchase_frequency_monthly,
      freq_universe AS purchase_frequency_universe_monthly, churn_pct, at_risk_sales, avg_breadth, low_pct AS low_breadth_pct, se.top3_pct AS seller_concentration_pct,
      100 - uncovered_pct AS route_coverage_pct, margin_pct, fo.top3_pct AS force_concentration_pct, pr.top3_pct AS product_concentration_pct, pr.growing AS growing_categories,
      pr.declining AS declining_categories, cn.leader_share AS top_channel_pct FROM trend, rk, ch, br, se, fo, pr, rt, mg, cn""", *BASE),
    rounded=("hhi", "dim_concentration_pct", "route_coverage_pct", "top_channel_pct"))
def kpi_ratios(fact):
    return ops.derived_ratios(ops.headlines(fact))


_R = lambda c: f"round({c}, 1)"
_INSIGHTS = [
    ("tempo_trend", "tiempo", "1", f"CASE WHEN {_R('trend_pct')} >= 3 THEN 'positive' WHEN {_R('trend_pct')} < 0 THEN 'alert' ELSE 'trend' END", "trend", "periods > 0", "trend_pct", "NULL"),
    ("tempo_forecast", "tiempo", "2", "'context'", "trend", "periods > 0", "projected", "NULL"),
    ("tempo_seasonal", "tiempo", "3", "'context'", "trend", "periods >= 12", "periods", "NULL"),
    ("rank_concentration", "cartera", f"CASE WHEN {_R('top3_pct')} >= 60 THEN 1 ELSE 2 END", f"CASE WHEN {_R('top3_pct')} >= 60 THEN 'alert' WHEN {_R('top3_pct')} >= 40 THEN 'trend' ELSE 'positive' END", "rk", "TRUE", "top3_pct", "NULL"),
    ("rank_leader", "cartera", "2", "'context'", "rk", f"{_R('leader_share')} >= 15", "leader_share", "leader"),
    ("churn_active_low", "cartera", "1", "'alert'", "ch", f"{_R('active_pct')} < 55", "active_pct", "NULL"),
    ("churn_active_ok", "cartera", "2", "'positive'", "ch", f"{_R('active_pct')} >= 75", "active_pct", "NULL"),
    ("churn_active_mid", "cartera", "2", "'trend'", "ch", f"{_R('active_pct')} >= 55 AND {_R('active_pct')} < 75", "active_pct", "NULL"),
    ("churn_rec_low", "cartera", "1", "'alert'", "ch", f"{_R('recurring_pct')} < 40", "recurring_pct", "NULL"),
    ("churn_rec_ok", "cartera", "2", "'positive'", "ch", f"{_R('recurring_pct')} >= 60", "recurring_pct", "NULL"),
    ("churn_opportunity", "cartera", "1", "'opportunity'", "ch", "dormant + reactivable > 0 AND at_risk_sales > 0", "at_risk_sales", "NULL"),
    ("churn_lost", "cartera", "2", "'alert'", "ch", "lost > 0", "lost", "NULL"),
    ("mix_breadth", "producto", "2", "'trend'", "br", "avg_breadth > 0", "avg_breadth", "CASE WHEN round(avg_breadth, 2) >= 4 THEN 'alta' WHEN round(avg_breadth, 2) >= 2.5 THEN 'media' ELSE 'baja' END"),
    ("mix_opportunity", "producto", "1", "'opportunity'", "br", "avg_breadth > 0 AND low > 0", "low", "NULL"),
    ("seller_concentration", "territorio", "1", "'alert'", "se", f"{_R('top3_pct')} >= 70", "top3_pct", "NULL"),
    ("seller_leader", "territorio", "2", "'positive'", "se", f"{_R('leader_growth_pct')} >= 10", "leader_growth_pct", "leader"),
    ("seller_leader_down", "territorio", "1", "'alert'", "se", f"{_R('leader_growth_pct')} < 0", "leader_growth_pct", "leader"),
    ("seller_negatives", "territorio", "2", "CASE WHEN falling > labels // 2 THEN 'alert' ELSE 'trend' END", "se", "falling > 0", "falling", "NULL"),
    ("geo_coverage_low", "territorio", "1", "'alert'", "rt", f"{_R('uncovered_pct')} >= 20", "uncovered_pct", "NULL"),
    ("geo_coverage_mid", "territorio", "2", "'trend'", "rt", f"{_R('uncovered_pct')} >= 5 AND {_R('uncovered_pct')} < 20", "uncovered_pct", "NULL"),
    ("geo_coverage_ok", "territorio", "3", "'positive'", "rt", f"{_R('uncovered_pct')} < 5", "uncovered_pct", "NULL"),
    ("margin_total", "margen", "1", f"CASE WHEN {_R('margin_pct')} >= 20 THEN 'positive' WHEN {_R('margin_pct')} < 10 THEN 'alert' ELSE 'trend' END", "mg", "TRUE", "margin_pct", "NULL"),
    ("margin_low_items", "margen", "1", "'alert'", "mi", "low > 0", "low", "NULL"),
    ("margin_leader", "margen", "2", "'opportunity'", "mi", f"{_R('best')} >= 25", "best", "best_label"),
    ("force_leader", "fuerza", "2", "'context'", "fo", "total > 0", "leader_share_pct", "leader"),
    ("force_imbalance", "fuerza", "2", "'alert'", "fo", "labels > 1 AND min_value > 0 AND max_value >= min_value * 5", "max_value", "NULL"),
    ("prod_leader", "producto", "2", "'context'", "pr", "leader IS NOT NULL", "leader_share_pct", "leader"),
    ("prod_growing", "producto", "2", "'positive'", "pr", "growing_strongly > 0", "growing_strongly", "NULL"),
    ("prod_declining", "producto", "1", "'alert'", "pr", "declining_notably > 0", "declining_notably", "NULL"),
    ("channel_mono", "canal", "2", "'alert'", "cn", f"{_R('leader_share')} >= 80", "leader_share", "leader"),
    ("channel_dominant", "canal", "2", "'trend'", "cn", f"{_R('leader_share')} >= 50 AND {_R('leader_share')} < 80", "leader_share", "leader"),
    ("channel_balanced", "canal", "3", "'positive'", "cn", f"{_R('leader_share')} < 50", "leader_share", "leader"),
]
_INS_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS id, '{d}' AS domain, CAST({p} AS BIGINT) AS priority, {k} AS type, CAST({v} AS DOUBLE) AS value, CAST({label} AS VARCHAR) AS label,
      CAST({_DOM[d]} AS BIGINT) AS domain_rank, CAST({i} AS BIGINT) AS position FROM {t} WHERE {w}""" for i, (n, d, p, k, t, w, v, label) in enumerate(_INSIGHTS))


@C.add("insights", with_fact(_INS_SQL, *BASE), rounded=("value",))
def insights(fact):
    return ops.insights(ops.headlines(fact, margin_dimension="brand"))


@C.add("insight_counts", with_fact(f"SELECT type, count(*) AS insights FROM ({_INS_SQL}) GROUP BY type", *BASE))
def insight_counts(fact):
    return ops.insight_counts(ops.insights(ops.headlines(fact, margin_dimension="brand")))
