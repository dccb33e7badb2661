"""Indicators, traffic lights and insight rules derived from the ten analyses."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ventara.functions.numbers import dbl, moderated, pct_change, share_pct, to_tenth, traffic_light
from ventara.functions.text import clean
from ventara.operators import analyses
from ventara.operators.core import IDENTITIES, amount_where, one_row, ranked, sales_grain
from ventara.operators.profile import TASKS
from ventara.plans.session import kept

# Thresholds (yellow, green); yellow above green means the scale is inverted.
THRESHOLDS = {
    "growth_pct": (0.0, 8.0), "active_pct": (55.0, 75.0), "recurring_pct": (40.0, 60.0), "concentration_top3": (60.0, 45.0),
    "coverage_pct": (80.0, 92.0), "churn_risk_pct": (30.0, 15.0), "margin_pct": (10.0, 20.0), "avg_breadth": (2.0, 3.0),
    "hhi": (2500.0, 1000.0), "seller_top3": (70.0, 50.0),
}

# Order of the domains in the lists.
KPI_DOMAINS = ("tiempo", "cartera", "territorio", "producto", "canal", "margen", "general")
INSIGHT_DOMAINS = ("tiempo", "cartera", "territorio", "producto", "canal", "margen", "fuerza", "general")


def _row(df: DataFrame) -> Column:
    return one_row(df, F.max(F.struct("*")).alias("r")).r


def label_sums(grain: DataFrame, dimensions: list[str], last: date) -> DataFrame:
    """(dimension, label, amount, recent, before) of several dimensions: sums of all time, of the last 90 days and of the 90 before.

    Combinations of labels are summed first, so a row of the grain is not copied for each dimension.
    """
    day = F.lit(last).cast("date")
    recent, before = F.col("date") >= F.date_sub(day, 89), F.col("date").between(F.date_sub(day, 179), F.date_sub(day, 90))
    combos = grain.groupBy(*[clean(d).alias(d) for d in dimensions]).agg(
        F.sum("amount").alias("amount"), amount_where(recent).alias("recent"), amount_where(before).alias("before"))
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in dimensions])
    return combos.select(F.inline(pairs), "amount", "recent", "before").groupBy("dimension", "label").agg(*[F.sum(c).alias(c) for c in ("amount", "recent", "before")])


def headlines(fact: DataFrame, ranking_dimension: str = "client", margin_dimension: str | None = None) -> DataFrame:
    """One row with the summary of every analysis as a struct column.

    The fact is read once, for its sales grain. From the grain come the sums of all labels (one pass), of the months, of the ranked
    dimension, of clients and of clients and families, and the margin; each is kept, and the summaries are made from these small
    tables. The row is kept as well: rules name its columns many times.
    """
    dimensions = ["seller_name", "sales_force", "family", "route_description", "channel"]
    labels = {*dimensions, ranking_dimension, *([margin_dimension] if margin_dimension else [])}
    grain = kept(sales_grain(fact, sorted(labels - set(IDENTITIES)), ("amount", "cost")))
    last = grain.agg(F.max("date").alias("day")).first()["day"]
    sums = kept(label_sums(grain, dimensions, last))
    items = kept(grain.groupBy(clean(ranking_dimension).alias("label")).agg(F.sum("amount").alias("exact")))
    margin = kept(analyses.margin_analysis(grain, margin_dimension))
    clients = kept(analyses.churn_clients(grain))
    trend = analyses.trend_outlook(grain).orderBy("forecast_period").limit(1)

    def performance(dimension: str) -> Column:
        own = sums.filter((F.col("dimension") == dimension) & (F.col("label") != ""))
        total = one_row(own, F.sum("amount").alias("t")).t
        stats = own.select("label", dbl("amount").alias("value"), share_pct("amount", total).alias("share_pct"), pct_change("recent", "before").alias("growth_pct"))
        return _row(analyses.performance_summary(kept(stats)))

    channels = sums.filter("dimension = 'channel' and label <> ''")
    channels = channels.select("label", dbl("amount").alias("value"), share_pct("amount", one_row(channels, F.sum("amount").alias("t")).t).alias("share_pct"))
    routes = sums.filter("dimension = 'route_description'").select("label", dbl("amount").alias("value"), (~F.lower("label").isin(*analyses.UNCOVERED_ROUTES)).alias("covered"))
    total = one_row(items, F.sum("exact").alias("t")).t
    ranking = ranked(items, 20, [F.desc("exact"), "label"]).select("rank", "label", share_pct("exact", total).alias("share_pct"))
    listed = margin.filter(~F.col("is_total"))
    return kept(fact.sparkSession.range(1).select(
        _row(trend).alias("trend"),
        _row(analyses.concentration_of(items)).alias("ranking"),
        one_row(ranking, F.min_by(F.struct("label", "share_pct"), "rank").alias("top"), F.count("*").alias("items")).alias("leader"),
        _row(analyses.churn_summary(clients)).alias("churn"),
        _row(analyses.breadth_summary(kept(analyses.client_breadth(grain)))).alias("breadth"),
        performance("seller_name").alias("seller"),
        _row(analyses.geographic_summary(routes)).alias("routes"),
        _row(margin.filter("is_total")).alias("margin"),
        one_row(listed, F.count_if(to_tenth("margin_pct") < 10).alias("low"), F.max(F.struct("margin_pct", "label")).alias("best"), F.count("*").alias("items")).alias("margin_items"),
        performance("sales_force").alias("force"),
        performance("family").alias("product"),
        _row(analyses.channel_summary(channels)).alias("channel"),
    ))


def _projected() -> Column:
    return F.col("trend.last3_avg") * 3 * moderated("trend.trend_pct")


def kpis(heads: DataFrame) -> DataFrame:
    """The 29 indicators with format, direction of change, domain and priority."""
    cards = [
        ("temporal_trend", "trend_pct", "trend.trend_pct", "pct"), ("temporal_trend", "base_monthly", "trend.last3_avg", "money"),
        ("temporal_trend", "projected_quarter", _projected(), "money"),
        ("dimension_ranking", "dim_total", "ranking.total", "money"), ("dimension_ranking", "top3_share", "ranking.top3_pct", "pct"),
        ("dimension_ranking", "hhi", "ranking.hhi_top", "int"),
        ("recurrence_churn", "total_clients", "churn.total_clients", "int"), ("recurrence_churn", "active_pct", "churn.active_pct", "pct"),
        ("recurrence_churn", "recurring_pct", "churn.recurring_pct", "pct"), ("recurrence_churn", "purchase_frequency_monthly", "churn.monthly_frequency", "text"),
        ("recurrence_churn", "avg_ticket", "churn.avg_ticket", "money"), ("recurrence_churn", "churn_at_risk", "churn.at_risk_sales", "money"),
        ("cross_sell_mix", "avg_breadth", "breadth.avg_breadth", "text"), ("cross_sell_mix", "low_breadth_pct", "breadth.low_breadth_pct", "pct"),
        ("seller_performance", "seller_total", "seller.total", "money"), ("seller_performance", "seller_top3_share", "seller.top3_pct", "pct"),
        ("seller_performance", "seller_count", "seller.labels", "int"),
        ("geographic_coverage", "geo_total", "routes.total", "money"), ("geographic_coverage", "geo_cov_pct", 100 - F.col("routes.uncovered_pct"), "pct"),
        ("margin_analysis", "total_revenue", "margin.revenue", "money"), ("margin_analysis", "total_margin", "margin.margin", "money"),
        ("margin_analysis", "margin_pct", "margin.margin_pct", "pct"),
        ("sales_force_breakdown", "force_total", "force.total", "money"), ("sales_force_breakdown", "force_top3_share", "force.top3_pct", "pct"),
        ("product_analysis", "product_total", "product.total", "money"), ("product_analysis", "product_top3_pct", "product.top3_pct", "pct"),
        ("product_analysis", "growing_cats", "product.growing", "int"),
        ("channel_analysis", "channel_total", "channel.total", "money"), ("channel_analysis", "top_channel_pct", "channel.leader_share_pct", "pct"),
    ]
    structs = []
    for i, (task, name, value, kind) in enumerate(cards):
        domain, priority = TASKS[task][0], TASKS[task][1]
        delta = dbl(value) if name == "trend_pct" else F.lit(None).cast("double")
        structs.append(F.struct(
            F.lit(name).alias("id"), dbl(value).alias("value"), F.lit(kind).alias("format"), delta.alias("delta"),
            F.when(delta > 0.5, "up").when(delta < -0.5, "down").otherwise("flat").alias("delta_dir"),
            F.lit(domain).alias("domain"), F.lit(priority).cast("long").alias("priority"),
            F.lit(KPI_DOMAINS.index(domain)).cast("long").alias("domain_rank"), F.lit(i).cast("long").alias("position"),
        ))
    return heads.select(F.inline_outer(F.array(*structs))).orderBy("priority", "domain_rank", "position")


def lights(heads: DataFrame) -> DataFrame:
    """Traffic lights, red first."""
    rows = [
        ("crecimiento", "trend.trend_pct", "growth_pct"), ("hhi", "ranking.hhi_top", "hhi"), ("cartera_activa", "churn.active_pct", "active_pct"),
        ("recurrencia", "churn.recurring_pct", "recurring_pct"), ("profundidad", "breadth.avg_breadth", "avg_breadth"),
        ("seller_conc", "seller.top3_pct", "seller_top3"), ("cobertura_ruta", 100 - F.col("routes.uncovered_pct"), "coverage_pct"),
        ("margen", "margin.margin_pct", "margin_pct"),
    ]
    structs = F.array(*[
        F.struct(F.lit(n).alias("id"), dbl(v).alias("value"), traffic_light(F.round(dbl(v), 2 if k == "avg_breadth" else 1), *THRESHOLDS[k]).alias("color"), F.lit(i).cast("long").alias("position"))
        for i, (n, v, k) in enumerate(rows)
    ])
    order = F.when(F.col("color") == "red", 0).when(F.col("color") == "yellow", 1).otherwise(2)
    return heads.select(F.inline_outer(structs)).orderBy(order, "position")


def derived_ratios(heads: DataFrame) -> DataFrame:
    """Ratios the insights refer to."""
    pick = lambda c, n: F.col(c).alias(n)
    return heads.select(
        pick("trend.trend_pct", "trend_pct"), pick("trend.last3_avg", "base_monthly"), pick("ranking.top3_pct", "dim_concentration_pct"), pick("ranking.hhi_top", "hhi"),
        pick("churn.active_pct", "active_pct"), pick("churn.recurring_pct", "recurring_pct"), pick("churn.monthly_frequency", "purchase_frequency_monthly"),
        pick("churn.monthly_frequency_universe", "purchase_frequency_universe_monthly"), pick("churn.churn_pct", "churn_pct"), pick("churn.at_risk_sales", "at_risk_sales"),
        pick("breadth.avg_breadth", "avg_breadth"), pick("breadth.low_breadth_pct", "low_breadth_pct"), pick("seller.top3_pct", "seller_concentration_pct"),
        (100 - F.col("routes.uncovered_pct")).alias("route_coverage_pct"), pick("margin.margin_pct", "margin_pct"), pick("force.top3_pct", "force_concentration_pct"),
        pick("product.top3_pct", "product_concentration_pct"), pick("product.growing", "growing_categories"), pick("product.declining", "declining_categories"),
        pick("channel.leader_share_pct", "top_channel_pct"),
    )


def _rules() -> list[tuple]:
    """(id, domain, priority, type, fires, value, label); percentages are compared with one decimal."""
    t = lambda c: to_tenth(F.col(c))
    c = F.col
    none = F.lit(None).cast("string")
    trend, top3 = t("trend.trend_pct"), t("ranking.top3_pct")
    active, recurring = t("churn.active_pct"), t("churn.recurring_pct")
    uncovered, margin, channel = t("routes.uncovered_pct"), t("margin.margin_pct"), t("channel.leader_share_pct")
    some = c("trend.periods") > 0
    ranked_items = c("leader.items") > 0
    clients = c("churn.total_clients") > 0
    recoverable = c("churn.dormant") + c("churn.reactivable")
    sellers, growth = c("seller.labels"), t("seller.leader_growth_pct")
    majority = c("seller.falling") > F.floor(sellers / 2)
    has_routes, has_margin, has_channel = c("routes.routes") > 0, margin != 0, c("channel.channels") > 0
    return [
        ("tempo_trend", "tiempo", 1, F.when(trend >= 3, "positive").when(trend < 0, "alert").otherwise("trend"), some, "trend.trend_pct", none),
        ("tempo_forecast", "tiempo", 2, F.lit("context"), some, _projected(), none),
        ("tempo_seasonal", "tiempo", 3, F.lit("context"), c("trend.periods") >= 12, "trend.periods", none),
        ("rank_concentration", "cartera", F.when(top3 >= 60, 1).otherwise(2), F.when(top3 >= 60, "alert").when(top3 >= 40, "trend").otherwise("positive"), ranked_items, "ranking.top3_pct", none),
        ("rank_leader", "cartera", 2, F.lit("context"), ranked_items & (t("leader.top.share_pct") >= 15), "leader.top.share_pct", c("leader.top.label")),
        ("churn_active_low", "cartera", 1, F.lit("alert"), clients & (active < 55), "churn.active_pct", none),
        ("churn_active_ok", "cartera", 2, F.lit("positive"), clients & (active >= 75), "churn.active_pct", none),
        ("churn_active_mid", "cartera", 2, F.lit("trend"), clients & (active >= 55) & (active < 75), "churn.active_pct", none),
        ("churn_rec_low", "cartera", 1, F.lit("alert"), clients & (recurring < 40), "churn.recurring_pct", none),
        ("churn_rec_ok", "cartera", 2, F.lit("positive"), clients & (recurring >= 60), "churn.recurring_pct", none),
        ("churn_opportunity", "cartera", 1, F.lit("opportunity"), (recoverable > 0) & (c("churn.at_risk_sales") > 0), "churn.at_risk_sales", none),
        ("churn_lost", "cartera", 2, F.lit("alert"), c("churn.lost") > 0, "churn.lost", none),
        ("mix_breadth", "producto", 2, F.lit("trend"), c("breadth.avg_breadth") > 0, "breadth.avg_breadth",
         F.when(F.round("breadth.avg_breadth", 2) >= 4, "alta").when(F.round("breadth.avg_breadth", 2) >= 2.5, "media").otherwise("baja")),
        ("mix_opportunity", "producto", 1, F.lit("opportunity"), (c("breadth.avg_breadth") > 0) & (c("breadth.low_breadth_clients") > 0), "breadth.low_breadth_clients", none),
        ("seller_concentration", "territorio", 1, F.lit("alert"), t("seller.top3_pct") >= 70, "seller.top3_pct", none),
        ("seller_leader", "territorio", 2, F.lit("positive"), growth >= 10, "seller.leader_growth_pct", c("seller.leader")),
        ("seller_leader_down", "territorio", 1, F.lit("alert"), growth < 0, "seller.leader_growth_pct", c("seller.leader")),
        ("seller_negatives", "territorio", 2, F.when(majority, "alert").otherwise("trend"), c("seller.falling") > 0, "seller.falling", none),
        ("geo_coverage_low", "territorio", 1, F.lit("alert"), has_routes & (uncovered >= 20), "routes.uncovered_pct", none),
        ("geo_coverage_mid", "territorio", 2, F.lit("trend"), has_routes & (uncovered >= 5) & (uncovered < 20), "routes.uncovered_pct", none),
        ("geo_coverage_ok", "territorio", 3, F.lit("positive"), has_routes & (uncovered < 5), "routes.uncovered_pct", none),
        ("margin_total", "margen", 1, F.when(margin >= 20, "positive").when(margin < 10, "alert").otherwise("trend"), has_margin, "margin.margin_pct", none),
        ("margin_low_items", "margen", 1, F.lit("alert"), has_margin & (c("margin_items.low") > 0), "margin_items.low", none),
        ("margin_leader", "margen", 2, F.lit("opportunity"), has_margin & (t("margin_items.best.margin_pct") >= 25), "margin_items.best.margin_pct", c("margin_items.best.label")),
        ("force_leader", "fuerza", 2, F.lit("context"), (c("force.labels") > 0) & (c("force.total") > 0), "force.leader_share_pct", c("force.leader")),
        ("force_imbalance", "fuerza", 2, F.lit("alert"), (c("force.labels") > 1) & (c("force.min_value") > 0) & (c("force.max_value") >= c("force.min_value") * 5), "force.max_value", none),
        ("prod_leader", "producto", 2, F.lit("context"), c("product.leader").isNotNull(), "product.leader_share_pct", c("product.leader")),
        ("prod_growing", "producto", 2, F.lit("positive"), c("product.growing_strongly") > 0, "product.growing_strongly", none),
        ("prod_declining", "producto", 1, F.lit("alert"), c("product.declining_notably") > 0, "product.declining_notably", none),
        ("channel_mono", "canal", 2, F.lit("alert"), has_channel & (channel >= 80), "channel.leader_share_pct", c("channel.leader")),
        ("channel_dominant", "canal", 2, F.lit("trend"), has_channel & (channel >= 50) & (channel < 80), "channel.leader_share_pct", c("channel.leader")),
        ("channel_balanced", "canal", 3, F.lit("positive"), has_channel & (channel < 50), "channel.leader_share_pct", c("channel.leader")),
    ]


def insights(heads: DataFrame) -> DataFrame:
    """Insight rules that fire, by priority and domain."""
    structs = F.array(*[
        F.when(fires, F.struct(
            F.lit(n).alias("id"), F.lit(d).alias("domain"), (p if isinstance(p, Column) else F.lit(p)).cast("long").alias("priority"), kind.alias("type"),
            dbl(v).alias("value"), label.alias("label"), F.lit(INSIGHT_DOMAINS.index(d)).cast("long").alias("domain_rank"), F.lit(i).cast("long").alias("position")))
        for i, (n, d, p, kind, fires, v, label) in enumerate(_rules())
    ])
    fired = heads.select(F.inline_outer(F.filter(structs, lambda x: x.isNotNull()))).filter(F.col("id").isNotNull())
    return fired.orderBy("priority", "domain_rank", "position")


def insight_counts(listed: DataFrame) -> DataFrame:
    return listed.groupBy("type").agg(F.count("*").alias("insights"))
