"""Queries for the named analyses."""

from pyspark.sql import functions as F

from checks.fixtures import Checks, with_fact
from ventara.operators import analyses, profile
from ventara.operators.core import sales_grain
from ventara.plans.session import kept

C = Checks()

PAIR_DIMS = ("channel", "sales_force", "family", "seller_name")

_RANK_ITEMS = """SELECT '{combo}' AS combo, {label} AS label, CAST(sum(amount) AS DOUBLE) AS value,
  count(DISTINCT coalesce(client_key, '')) AS clients, count(DISTINCT coalesce(invoice, '')) AS orders FROM fact GROUP BY 2"""


def _ranking_sql(label, combo="x"):
    return f"""SELECT rank, label, value, value / greatest((SELECT CAST(sum(amount) AS DOUBLE) FROM fact), 1) * 100 AS share_pct, clients, orders
    FROM (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rank FROM ({_RANK_ITEMS.format(combo=combo, label=label)})) WHERE rank <= 20"""


def _col(d):
    return f"coalesce({d}, '')"


def _all_combos_sql():
    sets = [(d,) for d in PAIR_DIMS] + [(a, b) for i, a in enumerate(PAIR_DIMS) for b in PAIR_DIMS[i + 1:]]
    union = " UNION ALL ".join(
        _RANK_ITEMS.format(combo=" / ".join(s), label=" || ' / ' || ".join(_col(d) for d in s)) for s in sets)
    return f"""SELECT combo, rank, label, value, value / greatest((SELECT CAST(sum(amount) AS DOUBLE) FROM fact), 1) * 100 AS share_pct, clients, orders
    FROM (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY value DESC, label) AS rank FROM ({union})) WHERE rank <= 20"""


@C.add("temporal_trend", with_fact("SELECT period, CAST(sum(amount) AS DOUBLE) AS value FROM fact GROUP BY period"))
def temporal_trend(fact):
    return analyses.temporal_trend(fact)


@C.add("temporal_trend_by_channel", with_fact(
    """SELECT l.label, m.period, CAST(coalesce(sum(f.amount), 0) AS DOUBLE) AS value
    FROM (SELECT DISTINCT coalesce(family, '') AS label FROM fact) l CROSS JOIN (SELECT DISTINCT period FROM fact) m
    LEFT JOIN fact f ON coalesce(f.family, '') = l.label AND f.period = m.period GROUP BY 1, 2"""))
def temporal_trend_by(fact):
    return analyses.temporal_trend_by(fact, "family")


@C.add("trend_outlook", with_fact(
    """SELECT periods, last3_avg, prev3_avg, trend_pct, forecast_period, last3_avg * (1 + greatest(least(trend_pct, 20), -20) * 0.6::DOUBLE / 100) AS forecast
    FROM (SELECT *, CASE WHEN prev3_avg = 0 THEN CASE WHEN last3_avg > 0 THEN 100 ELSE 0 END ELSE (last3_avg - prev3_avg) / prev3_avg * 100 END AS trend_pct
      FROM (SELECT count(*) AS periods, max(period) AS last_period, CAST(sum(value) FILTER (back <= 3) AS DOUBLE) / 3 AS last3_avg,
              CAST(sum(value) FILTER (back BETWEEN 4 AND 6) AS DOUBLE) / 3 AS prev3_avg
            FROM (SELECT period, sum(amount) AS value, row_number() OVER (ORDER BY period DESC) AS back FROM fact GROUP BY period))),
    (SELECT strftime(CAST((SELECT max(period) FROM fact) || '-01' AS DATE) + to_months(i::INT), '%Y-%m') AS forecast_period FROM range(1, 4) t(i))"""))
def trend_outlook(fact):
    return analyses.trend_outlook(fact)


@C.add("dimension_ranking", with_fact(_ranking_sql("channel")))
def dimension_ranking(fact):
    return analyses.dimension_ranking(fact, "channel")


@C.add("dimension_ranking_clients", with_fact(_ranking_sql("client")))
def dimension_ranking_clients(fact):
    return analyses.dimension_ranking(fact, "client")


@C.add("dimension_ranking_pair", with_fact(_ranking_sql("seller_name || ' / ' || coalesce(family, '')")))
def dimension_ranking_pair(fact):
    return analyses.dimension_ranking(fact, "seller_name", "family")


@C.add("ranking_concentration", with_fact(
    """SELECT total, top3 / greatest(total, 1) * 100 AS top3_pct, hhi_top, hhi_all FROM (
      SELECT max(total) AS total, CAST(sum(v) FILTER (rn <= 3) AS DOUBLE) AS top3,
        sum((v / greatest(total, 1)) * (v / greatest(total, 1))) FILTER (rn <= 20) * 10000 AS hhi_top,
        sum((v / greatest(total, 1)) * (v / greatest(total, 1))) * 10000 AS hhi_all
      FROM (SELECT CAST(sum(amount) AS DOUBLE) AS v, CAST(sum(sum(amount)) OVER () AS DOUBLE) AS total,
              row_number() OVER (ORDER BY sum(amount) DESC, seller_name) AS rn FROM fact GROUP BY seller_name))"""), rounded=("hhi_top", "hhi_all",))
def ranking_concentration(fact):
    return analyses.ranking_concentration(fact, "seller_name")


@C.add("ranking_grouping_sets", with_fact(_all_combos_sql()))
def ranking_grouping_sets(fact):
    return analyses.ranking_all_combos(fact, PAIR_DIMS)


CHURN_CTE = """churn AS (
  SELECT client_key, client, CASE WHEN recency_days <= greatest(30, gap * 1.2) THEN 'Activo' WHEN recency_days <= greatest(60, gap * 2) THEN 'Dormido'
       WHEN recency_days <= greatest(120, gap * 3) THEN 'Reactivable' ELSE 'Perdido' END AS status,
    sales12m, history_sales, CAST(last_date AS VARCHAR) AS last_date, recency_days, gap AS avg_gap_days, months_active,
    orders12 / 12.0::DOUBLE AS monthly_frequency, history_sales / greatest(CASE WHEN orders12 > 0 THEN orders12 ELSE oa END, 1) AS avg_ticket,
    CASE WHEN orders12 > 0 THEN orders12 ELSE oa END AS orders, orders12, segment
  FROM (SELECT client_key, arg_max(client, date) AS client, max(channel) AS segment,
      CAST(coalesce(sum(amount) FILTER (date >= m - 364), 0) AS DOUBLE) AS sales12m, CAST(sum(amount) AS DOUBLE) AS history_sales,
      max(date) AS last_date, date_diff('day', max(date), max(m)) AS recency_days,
      count(DISTINCT invoice) FILTER (date >= m - 364) AS orders12, count(DISTINCT invoice) AS oa,
      count(DISTINCT period) FILTER (date >= m - 364) AS months_active
    FROM fact, (SELECT max(date) AS m FROM fact) GROUP BY client_key)
  JOIN (SELECT client_key, coalesce(median(gap), 45) AS gap FROM (
      SELECT client_key, date_diff('day', lag(date) OVER (PARTITION BY client_key ORDER BY date), date) AS gap
      FROM (SELECT DISTINCT client_key, date FROM fact)) GROUP BY client_key) USING (client_key))"""


def _churn(fact):
    return analyses.churn_clients(fact, segment="channel")


@C.add("churn_clients", with_fact("SELECT * FROM churn", CHURN_CTE))
def churn_clients(fact):
    return _churn(fact)


@C.add("churn_risk_list", with_fact(
    """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'Perdido' THEN 0 WHEN 'Reactivable' THEN 1 WHEN 'Dormido' THEN 2 ELSE 3 END,
      history_sales DESC, client_key) AS rank FROM churn) WHERE rank <= 50""", CHURN_CTE))
def churn_risk_list(fact):
    return analyses.churn_risk_list(_churn(fact))


@C.add("churn_status", with_fact(
    "SELECT status, count(*) AS clients, CAST(sum(CAST(sales12m AS DECIMAL(28,4))) AS DOUBLE) AS sales12m FROM churn GROUP BY status", CHURN_CTE))
def churn_status(fact):
    return analyses.churn_status(_churn(fact))


@C.add("churn_summary", with_fact(
    """SELECT *, active / greatest(total_clients, 1) * 100 AS active_pct, recurring / greatest(total_clients, 1) * 100 AS recurring_pct,
      (dormant + reactivable + lost) / greatest(total_clients, 1) * 100 AS churn_pct,
      orders12m / 12 / greatest(buyers12m, 1) AS monthly_frequency, orders12m / 12 / greatest(total_clients, 1) AS monthly_frequency_universe
    FROM (SELECT count(*) AS total_clients, count(*) FILTER (status = 'Activo') AS active, count(*) FILTER (status = 'Dormido') AS dormant,
      count(*) FILTER (status = 'Reactivable') AS reactivable, count(*) FILTER (status = 'Perdido') AS lost,
      count(*) FILTER (months_active >= 4) AS recurring, CAST(sum(orders12) AS BIGINT) AS orders12m, count(*) FILTER (orders12 > 0) AS buyers12m,
      round(avg(round(avg_ticket, 2)), 6) AS avg_ticket,
      CAST(sum(CAST(history_sales AS DECIMAL(28,4))) FILTER (status IN ('Dormido', 'Reactivable')) AS DOUBLE) AS at_risk_sales FROM churn)""", CHURN_CTE), once=True)
def churn_summary(fact):
    return analyses.churn_summary(_churn(fact))


BREADTH_CTE = """breadth AS (SELECT client_key AS client, string_agg(family, ',' ORDER BY family) AS categories, count(*) AS breadth,
    CAST(sum(v) AS DOUBLE) AS value FROM (SELECT client_key, family, sum(amount) AS v FROM fact WHERE family IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


@C.add("cross_sell_mix", with_fact(
    "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY breadth DESC, value DESC, client) AS rank FROM breadth) WHERE rank <= 50", BREADTH_CTE))
def cross_sell_mix(fact):
    top = analyses.cross_sell_mix(fact)
    return top.withColumn("categories", F.array_join("categories", ","))


@C.add("breadth_distribution", with_fact("SELECT breadth, count(*) AS clients FROM breadth GROUP BY breadth", BREADTH_CTE))
def breadth_distribution(fact):
    return analyses.breadth_distribution(analyses.client_breadth(fact))


@C.add("breadth_summary", with_fact(
    """SELECT *, low_breadth_clients / greatest(clients, 1) * 100 AS low_breadth_pct FROM (
      SELECT count(*) AS clients, CAST(sum(breadth) AS DOUBLE) / count(*) AS avg_breadth, count(*) FILTER (breadth <= 1) AS low_breadth_clients,
        max(breadth) AS max_breadth FROM breadth)""", BREADTH_CTE))
def breadth_summary(fact):
    return analyses.breadth_summary(analyses.client_breadth(fact))


def _perf_sql(field):
    return f"""SELECT label, value, value / greatest(total, 1) * 100 AS share_pct, clients, orders,
      CASE WHEN prev = 0 THEN CASE WHEN cur > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (cur - prev) / prev * 100 END AS growth_pct
    FROM (SELECT {field} AS label, CAST(sum(amount) AS DOUBLE) AS value, CAST(sum(sum(amount)) OVER () AS DOUBLE) AS total,
      count(DISTINCT client_key) AS clients, count(DISTINCT invoice) AS orders,
      CAST(coalesce(sum(amount) FILTER (date >= m - 89), 0) AS DOUBLE) AS cur,
      CAST(coalesce(sum(amount) FILTER (date BETWEEN m - 179 AND m - 90), 0) AS DOUBLE) AS prev
    FROM fact, (SELECT max(date) AS m FROM fact) WHERE {field} IS NOT NULL GROUP BY 1)"""


@C.add("seller_growth_90d", with_fact(_perf_sql("seller_name")))
def seller_growth(fact):
    return analyses.seller_performance(fact)


@C.add("force_breakdown", with_fact(_perf_sql("sales_force")))
def force_breakdown(fact):
    return analyses.sales_force_breakdown(fact)


@C.add("product_analysis", with_fact(_perf_sql("family")))
def product_analysis(fact):
    return analyses.product_analysis(fact)


def _perf_summary_sql(field):
    return f"""SELECT CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS total, count(*) AS labels, count(*) FILTER (round(growth_pct, 1) > 5) AS growing,
      count(*) FILTER (round(growth_pct, 1) < -10) AS declining, count(*) FILTER (round(growth_pct, 1) < 0) AS falling,
      count(*) FILTER (round(growth_pct, 1) >= 10) AS growing_strongly, count(*) FILTER (round(growth_pct, 1) < -5) AS declining_notably,
      max(value) AS max_value, min(value) AS min_value,
      CAST(sum(CAST(value AS DECIMAL(28,4))) FILTER (rn <= 3) AS DOUBLE) / greatest(CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE), 1) * 100 AS top3_pct,
      max(label) FILTER (rn = 1) AS leader, max(share_pct) FILTER (rn = 1) AS leader_share_pct, max(growth_pct) FILTER (rn = 1) AS leader_growth_pct
    FROM (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rn FROM ({_perf_sql(field)}))"""


@C.add("product_summary", with_fact(_perf_summary_sql("family")), rounded=("top3_pct",))
def product_summary(fact):
    return analyses.performance_summary(analyses.product_analysis(fact))


@C.add("seller_summary", with_fact(_perf_summary_sql("seller_name")), rounded=("top3_pct",))
def seller_summary(fact):
    return analyses.performance_summary(analyses.seller_performance(fact))


CHANNEL_CTE = """channels AS (SELECT channel AS label, CAST(sum(amount) AS DOUBLE) AS value,
    CAST(sum(amount) AS DOUBLE) / greatest(CAST(sum(sum(amount)) OVER () AS DOUBLE), 1) * 100 AS share_pct, count(DISTINCT client_key) AS clients FROM fact GROUP BY 1)"""


@C.add("channel_share", with_fact("SELECT * FROM channels", CHANNEL_CTE))
def channel_share(fact):
    return analyses.channel_analysis(fact)


@C.add("channel_summary", with_fact(
    """SELECT count(*) AS channels, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS total, arg_max(label, value) AS leader,
      arg_max(share_pct, value) AS leader_share_pct FROM channels""", CHANNEL_CTE))
def channel_summary(fact):
    return analyses.channel_summary(analyses.channel_analysis(fact))


ROUTES_CTE = """route_rows AS (SELECT coalesce(route_description, '') AS label, CAST(sum(amount) AS DOUBLE) AS value,
    CAST(sum(amount) AS DOUBLE) / greatest(CAST(sum(sum(amount)) OVER () AS DOUBLE), 1) * 100 AS share_pct,
    count(DISTINCT client_key) AS clients, coalesce(route_description, '') <> '' AS covered FROM fact GROUP BY route_description)"""


@C.add("route_coverage", with_fact("SELECT * FROM route_rows", ROUTES_CTE))
def route_coverage(fact):
    return analyses.geographic_coverage(fact)


@C.add("route_coverage_summary", with_fact(
    """SELECT *, uncovered_value / greatest(total, 1) * 100 AS uncovered_pct FROM (
      SELECT CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS total, count(*) AS routes,
        CAST(sum(CAST(value AS DECIMAL(28,4))) FILTER (NOT covered) AS DOUBLE) AS uncovered_value FROM route_rows)""", ROUTES_CTE))
def route_coverage_summary(fact):
    return analyses.geographic_summary(analyses.geographic_coverage(fact))


@C.add("margin_by_dim", with_fact(
    """SELECT label, is_total, CAST(rev AS DOUBLE) AS revenue, CAST(cst AS DOUBLE) AS cost, CAST(rev - cst AS DOUBLE) AS margin,
      CAST(rev - cst AS DOUBLE) / greatest(CAST(rev AS DOUBLE), 1) * 100 AS margin_pct, volume FROM (
      SELECT coalesce(brand, '') AS label, FALSE AS is_total, sum(amount) AS rev, sum(cost) AS cst, count(*) AS volume FROM fact GROUP BY 1
      UNION ALL SELECT 'Total', TRUE, sum(amount), sum(cost), count(*) FROM fact)"""))
def margin_by_dim(fact):
    return analyses.margin_analysis(fact, "brand")


# --- analyses on resolved fields --------------------------------------------------------------


@C.add("run_task", with_fact(f"""SELECT 'line' AS dataset, label, value FROM ({_perf_sql("brand")})
    UNION ALL SELECT 'units', period, CAST(sum(quantity) AS DOUBLE) FROM fact GROUP BY period"""))
def run_task(fact):
    """A dataset without families, where the product slot falls to the line, and one that has units only.

    Profiles and analyses read the same few columns, which are joined once and kept.
    """
    fact = kept(sales_grain(fact, ("brand", "product_name", "channel"), identities=("date", "client_key", "invoice")))
    lined = fact.withColumn("line", F.col("brand")).drop("family", "brand")
    slots = profile.slots_of(profile.profile(lined, ("date", "line", "product_name", "amount", "quantity")), "product_analysis")
    units = fact.drop("amount", "period")
    metric = profile.slots_of(profile.profile(units, ("date", "channel", "quantity")), "temporal_trend")
    by_line = analyses.run_task(lined, "product_analysis", slots).select(F.lit("line").alias("dataset"), "label", "value")
    return by_line.unionByName(analyses.run_task(units, "temporal_trend", metric).select(F.lit("units").alias("dataset"), F.col("period").alias("label"), "value"))
