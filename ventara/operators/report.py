"""Blocks of the full report.

Each block takes the frames it builds on (client statistics, dimension statistics, coverage), so a
caller that needs several blocks computes those once and keeps them, see `report_base`.
Single-row inputs enter as scalar subqueries; nothing is collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ventara.functions.numbers import dbl, moderated, pct_change, ratio, share_pct, to_tenth, traffic_light
from ventara.functions.rows import literal_rows
from ventara.functions.text import clean, is_missing_label, lower_trim
from ventara.operators.core import (
    REPORT_IDENTITIES, REPORT_LABELS, amount_where, client_stats, dimension_stats, one_row, order_key, ranked, sales_grain, status_rank, unpivot_dimensions, weight,
)
from ventara.plans.period import Period, month_labels
from ventara.plans.schema import ARTICLE_ATTRIBUTES, CUBE_DIMENSIONS, CUBE_METRICS
from ventara.plans.session import kept


@dataclass
class ReportBase:
    """The aggregates the report blocks share."""

    fact: DataFrame
    period: Period
    clients: DataFrame
    dimensions: DataFrame
    keep: bool = False

    def _kept(self, df: DataFrame) -> DataFrame:
        return kept(df) if self.keep else df

    @property
    def coverage(self) -> DataFrame:
        return coverage(self.fact.filter(self.period.in_selected()))

    @cached_property
    def figures(self) -> DataFrame:
        """One row: totals of the period, and client totals `c`, dimension totals `by`, coverage `cov` and the share `top10` of the largest clients."""
        row = period_totals(self.fact, self.period)
        cov = one_row(self.coverage, F.max(F.struct("*")).alias("c")).c
        return self._kept(row.select("*", _client_totals(self.clients).alias("c"), _dimension_totals(self.dimensions).alias("by"), cov.alias("cov"), _top_share(self.clients, 10).alias("top10")))

    @cached_property
    def summary(self) -> DataFrame:
        return self._kept(summary(self))

    @cached_property
    def forecast(self) -> DataFrame:
        return self._kept(_forecast_row(self.fact, self.period))


def report_base(fact: DataFrame, period: Period, keep: bool = False) -> ReportBase:
    """Client and dimension statistics.

    With `keep` the fact is read once, for the columns of the blocks, which are kept; and so are the statistics and the one-row figures that
    several blocks use, each when it is first asked for. They go when the report does. Kept measures have the fact's own type, which can be
    shorter than the one they are summed in, and what changes from line to line of an order stands last, so that the files compress well.
    """
    if keep:
        columns = [c for c in ("amount", "quantity", *sorted((*REPORT_IDENTITIES, *REPORT_LABELS), key=lambda c: c in ARTICLE_ATTRIBUTES)) if c in fact.columns]
        fact = sales_grain(kept(fact.select(*columns)), REPORT_LABELS, identities=REPORT_IDENTITIES)
    clients, dimensions = client_stats(fact, period), dimension_stats(fact, period)
    if keep:
        clients, dimensions = kept(clients), kept(dimensions)
    return ReportBase(fact, period, clients, dimensions, keep)


def exact(x) -> Column:
    """Amounts with the six decimals that measures are parsed to, so that sums do not depend on row order."""
    return F.col(x).cast("decimal(38,6)") if isinstance(x, str) else x.cast("decimal(38,6)")


# --- coverage, totals -----------------------------------------------------------------------


def coverage(rows: DataFrame) -> DataFrame:
    """Share of rows with route, force, article and seller, and the sales without them."""
    no_route, no_force = F.col("route_description").isNull(), F.col("sales_force").isNull()
    no_article, no_seller = ~F.col("has_article_match"), F.col("seller_name").isNull()
    w = weight(rows)
    count = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    total = F.coalesce(F.sum(w), F.lit(0))
    return rows.agg(
        share_pct(count(~no_route), total).alias("route_pct"),
        share_pct(count(~no_force), total).alias("sales_force_pct"),
        share_pct(count(~no_article), total).alias("article_pct"),
        share_pct(count(F.col("has_seller_match")), total).alias("seller_pct"),
        dbl(amount_where(no_route)).alias("sales_without_route"),
        dbl(amount_where(no_article)).alias("sales_without_article"),
        dbl(amount_where(no_seller)).alias("sales_without_seller"),
        dbl(F.coalesce(F.sum("amount"), F.lit(0))).alias("sales_total"),
    )


def period_totals(fact: DataFrame, period: Period) -> DataFrame:
    """Sales, units, orders and buyers of the selected period, and sales and units of the comparison."""
    cur, prev = period.in_selected(), period.in_comparison()
    return fact.filter(cur | prev).agg(
        dbl(amount_where(cur)).alias("sales"),
        dbl(amount_where(prev)).alias("previous_sales"),
        dbl(amount_where(cur, "quantity")).alias("units"),
        dbl(amount_where(prev, "quantity")).alias("previous_units"),
        F.count_distinct(F.when(cur, order_key())).alias("orders"),
        F.count_distinct(F.when(cur, F.nullif(clean("client_key"), F.lit("")))).alias("buyers"),
    )


def _client_totals(clients: DataFrame) -> Column:
    is_status = lambda s: F.count_if(F.col("status") == s)
    at_risk = F.col("status").isin("Dormido", "Reactivable")
    low = (F.col("status") == "Activo") & (F.col("families") <= 1)
    return one_row(
        clients,
        F.greatest(F.count("*"), F.lit(1)).alias("clients"),
        is_status("Activo").alias("active"),
        is_status("Dormido").alias("dormant"),
        is_status("Reactivable").alias("reactivable"),
        is_status("Perdido").alias("lost"),
        F.count_if(F.col("months_active") >= 4).alias("recurring"),
        dbl(F.coalesce(F.sum(F.round("avg_ticket", 2).cast("decimal(28,2)")), F.lit(0))).alias("ticket_sum"),
        F.coalesce(F.sum("families"), F.lit(0)).alias("families"),
        F.coalesce(F.sum(F.greatest(F.col("families"), F.lit(1))), F.lit(0)).alias("families_min1"),
        dbl(F.coalesce(F.sum(exact("sales")), F.lit(0))).alias("sales"),
        dbl(F.coalesce(F.sum(F.when(at_risk, exact("history_sales"))), F.lit(0))).alias("at_risk_history"),
        F.count_if(low).alias("low_breadth"),
    )


def _top_share(stats: DataFrame, n: int) -> Column:
    top = ranked(stats.select(exact("sales").alias("v")), n, [F.desc("v")])
    total = one_row(stats, F.coalesce(F.sum(exact("sales")), F.lit(0)).alias("t")).t
    return share_pct(one_row(top, F.coalesce(F.sum("v"), F.lit(0)).alias("s")).s, total)


def _dimension_totals(dimensions: DataFrame) -> Column:
    """Number of real labels, top shares and best label per dimension, as one row of named columns."""
    sums = dimensions.groupBy("dimension").agg(
        F.count_if(~is_missing_label("label")).alias("real"),
        F.count_if(F.col("sales") > 0).alias("selling"),
        F.sum(exact("sales")).alias("total"),
        F.max("sales").alias("best"),
    )
    tops = ranked(dimensions.select("dimension", "label", exact("sales").alias("v")), 3, [F.desc("v"), "label"], by=["dimension"])
    tops = tops.groupBy("dimension").agg(F.sum("v").alias("top3"), F.max("v").alias("top1"))
    per_dim = sums.join(tops, "dimension")
    value = F.struct(
        "real", "selling", "best",
        share_pct("top3", "total").alias("top3_pct"), share_pct("top1", "total").alias("top1_pct"),
    )
    return one_row(per_dim, F.map_from_entries(F.collect_list(F.struct("dimension", value.alias("value")))).alias("by")).by


def _dim(by: Column, name: str, field: str, default) -> Column:
    return F.coalesce(F.try_element_at(by, F.lit(name))[field], F.lit(default))


# --- summary, ratios ------------------------------------------------------------------------


def summary(base: ReportBase) -> DataFrame:
    """Headline figures of the period in one row."""
    months = base.period.months
    row = base.figures
    total = F.col("c.clients")
    b = F.col("by")
    real = {d: _dim(b, d, "real", 0) for d in (
        "seller_name", "sales_force", "route_description", "family", "brand", "business_unit", "channel")}
    return row.select(
        ((F.col("units") > 0) | (F.col("previous_units") > 0)).alias("volume_mode"),
        F.lit(base.period.days).cast("long").alias("period_days"),
        F.lit(months).cast("long").alias("period_months"),
        "sales", "previous_sales", pct_change("sales", "previous_sales").alias("sales_growth_pct"),
        "units", "previous_units", pct_change("units", "previous_units").alias("units_growth_pct"),
        "orders", (dbl("orders") / months).alias("orders_per_month"),
        ratio("sales", "orders").alias("avg_order_value"),
        ratio("sales", "units").alias("avg_unit_price"),
        ratio("units", "orders").alias("avg_units_per_order"),
        F.col("c.active").alias("active_clients"), F.col("buyers").alias("buying_clients"),
        share_pct("c.active", total).alias("active_pct"),
        ratio(dbl("orders") / months, "buyers").alias("frequency_monthly"),
        ratio(dbl("orders") / months, total).alias("frequency_universe_monthly"),
        F.col("c.dormant").alias("dormant_clients"), F.col("c.reactivable").alias("reactivable_clients"),
        F.col("c.lost").alias("lost_clients"), F.col("c.recurring").alias("recurring_clients"),
        share_pct("c.recurring", total).alias("recurring_pct"),
        ratio("c.ticket_sum", total).alias("avg_ticket"),
        ratio("c.families", total).alias("avg_families_per_client"),
        F.col("top10").alias("top10_share_pct"),
        real["seller_name"].alias("seller_count"), real["sales_force"].alias("sales_force_count"),
        real["route_description"].alias("route_count"), real["family"].alias("family_count"),
        real["brand"].alias("brand_count"), real["business_unit"].alias("business_unit_count"),
        real["channel"].alias("channel_count"),
        ratio("sales", real["seller_name"]).alias("sales_per_seller"),
        ratio("units", real["seller_name"]).alias("units_per_seller"),
        _dim(b, "brand", "top1_pct", 0.0).alias("top_brand_pct"),
        _dim(b, "business_unit", "top1_pct", 0.0).alias("top_business_unit_pct"),
        _dim(b, "channel", "top1_pct", 0.0).alias("top_channel_pct"),
        share_pct(dbl("c.active") + dbl("c.reactivable") * 0.5, total).alias("portfolio_health_pct"),
        F.col("cov.route_pct").alias("route_pct"), F.col("cov.article_pct").alias("article_pct"),
        F.col("cov.seller_pct").alias("seller_pct"),
    )


def ratios(base: ReportBase) -> DataFrame:
    """Values per client, buyer and seller, concentration, breadth, portfolio shares and leakage."""
    months = base.period.months
    row = base.figures
    total, b = F.col("c.clients"), F.col("by")
    sellers = F.greatest(_dim(b, "seller_name", "real", 0), F.lit(1))
    leak = lambda f: (100 - F.col(f"cov.{f}"))
    return row.select(
        (F.col("units") > 0).alias("volume_mode"),
        ratio("sales", total).alias("sales_per_client"), ratio("sales", "buyers").alias("sales_per_buyer"),
        ratio("sales", sellers).alias("sales_per_seller"),
        ratio("units", total).alias("units_per_client"), ratio("units", "buyers").alias("units_per_buyer"),
        ratio("units", sellers).alias("units_per_seller"),
        ratio(total, sellers).alias("clients_per_seller"),
        ratio(F.greatest(F.col("orders"), F.lit(1)), sellers).alias("orders_per_seller"),
        F.col("orders").alias("total_orders"), F.lit(months).cast("long").alias("period_months"), total.alias("total_clients"),
        (dbl("orders") / months).alias("orders_per_month"),
        ratio(dbl("orders") / months, "buyers").alias("frequency_monthly"),
        ratio(dbl("orders") / months, total).alias("frequency_universe_monthly"),
        F.col("buyers").alias("buying_clients"), share_pct("buyers", total).alias("buying_pct"),
        ratio("sales", "orders").alias("avg_order_value"), ratio("units", "orders").alias("avg_units_per_order"),
        ratio("sales", "units").alias("avg_unit_price"),
        _dim(b, "sales_force", "top3_pct", 0.0).alias("top3_forces_pct"),
        _dim(b, "seller_name", "top3_pct", 0.0).alias("top3_sellers_pct"),
        F.col("top10").alias("top10_clients_pct"),
        _dim(b, "brand", "top1_pct", 0.0).alias("top_brand_pct"),
        _dim(b, "business_unit", "top1_pct", 0.0).alias("top_business_unit_pct"),
        _dim(b, "channel", "top1_pct", 0.0).alias("top_channel_pct"),
        ratio("c.families", total).alias("families_per_client"), ratio("c.families", "buyers").alias("families_per_buyer"),
        F.col("c.dormant").alias("dormant_clients"), F.col("c.reactivable").alias("reactivable_clients"),
        F.col("c.lost").alias("lost_clients"), F.col("c.recurring").alias("recurring_clients"),
        share_pct("c.dormant", total).alias("dormant_pct"), share_pct("c.reactivable", total).alias("reactivable_pct"),
        share_pct("c.lost", total).alias("lost_pct"), share_pct("c.recurring", total).alias("recurring_pct"),
        share_pct(F.col("sales") - F.col("cov.sales_without_article") - F.col("cov.sales_without_route"), "sales").alias("mapped_sales_pct"),
        leak("route_pct").alias("route_leakage_pct"), leak("article_pct").alias("article_leakage_pct"),
        leak("seller_pct").alias("seller_leakage_pct"),
    )


# --- supplier focus -------------------------------------------------------------------------


def _trend_labels(period: Period) -> list[str]:
    labels = month_labels(period.comparison_start, period.selected_end)
    if len(labels) < 2:
        labels = period.labels
    if len(labels) < 2:
        labels = [f"{period.comparison_end:%Y-%m}", f"{period.selected_end:%Y-%m}"]
    return labels


def supplier_months(fact: DataFrame, period: Period, supplier: str) -> DataFrame:
    """Per month of the period: clients of the supplier, active clients and coverage."""
    mine = lower_trim("supplier") == supplier.strip().lower()
    client = F.nullif(clean("client_key"), F.lit(""))
    rows = fact.filter(period.in_selected())
    active = one_row(rows, F.count_distinct(client).alias("n")).n
    stats = rows.groupBy("period").agg(
        F.count_distinct(F.when(mine, client)).alias("supplier_clients"),
        F.count_distinct(client).alias("active_clients"),
    )
    months = literal_rows(fact.sparkSession, ["period"], [(x,) for x in period.labels])
    return months.join(stats, "period", "left").na.fill(0).select(
        "period", "supplier_clients", "active_clients", active.alias("period_clients"),
        share_pct("supplier_clients", "active_clients").alias("coverage_pct"),
    )


def supplier_focus(fact: DataFrame, period: Period, supplier: str) -> DataFrame:
    """One supplier against all active clients: mix, ticket, coverage and month-over-month growth."""
    cur = period.in_selected()
    mine = lower_trim("supplier") == supplier.strip().lower()
    client = F.nullif(clean("client_key"), F.lit(""))
    *_, before, last = _trend_labels(period)
    in_month = lambda label: mine & (F.col("period") == label) & (cur | period.in_comparison())
    row = fact.filter(cur | period.in_comparison()).agg(
        dbl(amount_where(cur & mine)).alias("sales"),
        dbl(amount_where(cur & mine, "quantity")).alias("units"),
        F.count_distinct(F.when(cur & mine, client)).alias("clients"),
        F.count_distinct(F.when(cur & mine, order_key())).alias("orders"),
        F.count_distinct(F.when(cur, client)).alias("period_clients"),
        dbl(amount_where(cur)).alias("total_sales"),
        dbl(amount_where(in_month(last) & cur)).alias("last_month_sales"),
        dbl(amount_where(in_month(before))).alias("previous_month_sales"),
    )
    months = one_row(
        supplier_months(fact, period, supplier),
        F.max_by(F.struct("supplier_clients", "active_clients", "coverage_pct"), "period").alias("last"),
        (dbl(F.sum("active_clients")) / F.greatest(dbl(F.count("*")), F.lit(1.0))).alias("avg_active"),
    )
    return row.withColumn("m", months).select(
        F.lit(supplier.strip()).alias("supplier"), "sales", "units", "clients", "orders", "period_clients",
        F.col("m.last.active_clients").alias("active_clients"), F.col("m.avg_active").alias("avg_active_clients"),
        ratio("units", "period_clients").alias("units_per_client"),
        ratio("sales", "period_clients").alias("sales_per_client"),
        F.col("m.last.coverage_pct").alias("coverage_pct"), F.col("m.last.supplier_clients").alias("supplier_clients"),
        share_pct("sales", "total_sales").alias("mix_pct"), ratio("sales", "orders").alias("ticket"),
        F.lit(last).alias("last_month"), F.lit(before).alias("previous_month"),
        "last_month_sales", "previous_month_sales",
        pct_change("last_month_sales", "previous_month_sales").alias("growth_pct"),
    )


# --- forecast, opportunities, alerts, lights ------------------------------------------------


def _forecast_row(fact: DataFrame, period: Period) -> DataFrame:
    n = float(period.months)
    row = period_totals(fact, period).select(
        "sales", "units",
        pct_change("sales", "previous_sales").alias("trend_pct"),
        pct_change("units", "previous_units").alias("units_trend_pct"),
    )
    return row.select(
        (F.col("sales") / n).alias("base_sales"), (F.col("units") / n).alias("base_units"),
        "trend_pct", "units_trend_pct", (F.col("units") > 0).alias("volume_mode"),
        (F.col("sales") * moderated("trend_pct")).alias("projected_sales"),
        (F.col("units") * moderated("units_trend_pct")).alias("projected_units"),
    )


def forecast(fact: DataFrame, period: Period) -> DataFrame:
    """Months of the period with their sums, followed by as many projected months."""
    n = float(period.months)
    rows = fact.filter(period.in_selected()).groupBy("period").agg(
        dbl(F.sum("amount")).alias("sales"), dbl(F.sum("quantity")).alias("units"))
    months = literal_rows(fact.sparkSession, ["period"], [(x,) for x in period.labels])
    head = one_row(_forecast_row(fact, period), F.max(F.struct("*")).alias("f")).f
    actual = months.join(rows, "period", "left").na.fill(0.0).select("period", F.lit("real").alias("kind"), "sales", "units")
    ahead = literal_rows(fact.sparkSession, ["period"], [(x,) for x in period.next_labels]).select(
        "period", F.lit("proyección").alias("kind"),
        (head.projected_sales / n).alias("sales"), (head.projected_units / n).alias("units"),
    )
    return actual.unionByName(ahead)


def forecast_summary(fact: DataFrame, period: Period) -> DataFrame:
    return _forecast_row(fact, period)


def opportunity_totals(base: ReportBase) -> DataFrame:
    """Sales that could be recovered: dormant clients, cross-selling, routes and the leading family."""
    row = base.figures.select(F.col("cov.sales_without_route").alias("sales_without_route"), "c", "by").select(
        (F.col("c.at_risk_history") * 0.15).alias("recover_dormant"),
        (dbl("c.low_breadth") * ratio("c.sales", "c.families_min1") * 0.12).alias("cross_sell"),
        (F.col("sales_without_route") * 0.08).alias("route_optimization"),
        (_dim(F.col("by"), "family", "best", 0.0) * 0.06).alias("family_push"),
        F.col("c.low_breadth").alias("low_breadth_clients"),
        _dim(F.col("by"), "route_description", "selling", 0).alias("routes_tracked"),
    )
    total = F.col("recover_dormant") + F.col("cross_sell") + F.col("route_optimization") + F.col("family_push")
    return row.withColumn("total_potential", total)


def _rule_rows(row: DataFrame, rules: list[tuple], names: list[str]) -> DataFrame:
    """One row per rule of a one-row frame: rule number, fixed texts, trigger and value."""
    structs = [
        F.struct(F.lit(i).cast("long").alias("rule"), *[F.lit(t).alias(n) for n, t in zip(names, texts)],
                 F.coalesce(trigger, F.lit(False)).alias("fires"), dbl(value).alias("value"), label.alias("label"))
        for i, (texts, trigger, value, label) in enumerate(rules, start=1)
    ]
    return row.select(F.inline_outer(F.array(*structs)))


def _none() -> Column:
    return F.lit(None).cast("string")


def alerts(base: ReportBase, limit: int = 8) -> DataFrame:
    """Alerts that fire, in rule order, with the value that triggered them."""
    head = one_row(base.summary, F.max(F.struct("top10_share_pct", "top_brand_pct", "top_channel_pct", "route_pct", "article_pct")).alias("s")).s
    by = one_row(base.figures, F.first("by").alias("by")).by
    falling = base.dimensions.filter((F.col("dimension") == "family") & (to_tenth("growth_pct") <= -15))
    worst = one_row(falling, F.min(F.struct("growth_pct", "label")).alias("w")).w
    low = one_row(base.figures, F.max("c.low_breadth").alias("n")).n
    row = base.fact.sparkSession.range(1).select(head.alias("s"), by.alias("by"), worst.alias("w"), low.alias("low"))
    b = F.col("by")
    sellers, forces = _dim(b, "seller_name", "top3_pct", 0.0), _dim(b, "sales_force", "top3_pct", 0.0)
    tenth = lambda x: to_tenth(F.col(x))
    rules = [
        (("rutas", "high"), tenth("s.route_pct") < 85, "s.route_pct", _none()),
        (("articulos", "medium"), tenth("s.article_pct") < 85, "s.article_pct", _none()),
        (("cartera", "high"), tenth("s.top10_share_pct") >= 55, "s.top10_share_pct", _none()),
        (("surtido", "medium"), F.col("low") >= 10, "low", _none()),
        (("vendedores", "medium"), sellers >= 60, sellers, _none()),
        (("familia", "medium"), F.col("w").isNotNull(), F.col("w.growth_pct"), F.col("w.label")),
        (("fuerzas", "medium"), forces >= 60, forces, _none()),
        (("marca", "medium"), F.col("s.top_brand_pct") >= 45, "s.top_brand_pct", _none()),
        (("canal", "medium"), F.col("s.top_channel_pct") >= 55, "s.top_channel_pct", _none()),
    ]
    fired = _rule_rows(row, rules, ["topic", "severity"]).filter("fires").drop("fires")
    return fired.orderBy("rule").limit(limit)


def semaphores(base: ReportBase) -> DataFrame:
    """Six traffic lights; growth and projection use units when there are any."""
    s = one_row(base.summary, F.max(F.struct(
        "volume_mode", "units_growth_pct", "sales_growth_pct", "portfolio_health_pct", "route_pct", "article_pct", "seller_pct")).alias("s")).s
    f = one_row(base.forecast, F.max(F.struct("volume_mode", "units_trend_pct", "trend_pct")).alias("f")).f
    row = base.fact.sparkSession.range(1).select(s.alias("s"), f.alias("f"))
    lights = [
        ("Evolución del período", F.when(F.col("s.volume_mode"), F.col("s.units_growth_pct")).otherwise(F.col("s.sales_growth_pct")), 0.0, 8.0),
        ("Calidad de cartera", F.col("s.portfolio_health_pct"), 65.0, 80.0),
        ("Cobertura de rutas", F.col("s.route_pct"), 85.0, 95.0),
        ("Cobertura de artículos", F.col("s.article_pct"), 85.0, 95.0),
        ("Cobertura de vendedores", F.col("s.seller_pct"), 80.0, 95.0),
        ("Proyección", F.when(F.col("f.volume_mode"), F.col("f.units_trend_pct")).otherwise(F.col("f.trend_pct")), 0.0, 8.0),
    ]
    structs = [
        F.struct(F.lit(n).alias("name"), v.alias("value"), traffic_light(to_tenth(v), lo, hi).alias("color")) for n, v, lo, hi in lights
    ]
    return row.select(F.inline_outer(F.array(*structs)))


# --- item lists, series, cube ---------------------------------------------------------------

# Item lists of the charts: list, dimension, metric.
ITEM_LISTS = (
    ("fuerzas_importe", "sales_force", "sales"), ("fuerzas_unidades", "sales_force", "quantity"),
    ("vendedores_productividad", "seller_name", "avg_order_value"), ("vendedores_unidades", "seller_name", "quantity"),
    ("marcas_importe", "brand", "sales"), ("marcas_unidades", "brand", "quantity"),
    ("canales_importe", "channel", "sales"), ("canales_unidades", "channel", "quantity"),
)


def _list_rows(stats: DataFrame, lists) -> DataFrame:
    """Long form of several (list, dimension, metric) lists over the same statistics."""
    structs = F.array(*[
        F.when(F.col("dimension") == d, F.struct(F.lit(n).alias("list"), F.col("label"), F.col(m).cast("double").alias("value"))) for n, d, m in lists
    ])
    return stats.select(F.inline_outer(F.filter(structs, lambda x: x.isNotNull()))).filter(F.col("list").isNotNull())


def top_items(dimensions: DataFrame, lists=ITEM_LISTS, n: int = 8) -> DataFrame:
    """Largest labels of each chart list."""
    return ranked(_list_rows(dimensions, lists), n, [F.desc("value"), "label"], by=["list"])


def monthly_series(rows: DataFrame, labels: list[str], dimensions=("seller_name", "brand", "channel"), metrics=("amount", "quantity"), n: int = 8) -> DataFrame:
    """Month values of the n largest labels per dimension and metric, zero where a month has none."""
    long = unpivot_dimensions(rows, dimensions, ["period", *metrics])
    return _filled_series(long, ["dimension"], metrics, labels, n)


def _filled_series(long: DataFrame, by: list[str], metrics, labels: list[str], n: int) -> DataFrame:
    """Series of the largest labels. Sums are kept per (label, month) before labels are ranked."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("decimal(38,6)").alias("v")) for m in metrics])
    sums = long.groupBy(*by, "label", "period").agg(*[F.sum(m).alias(m) for m in metrics])
    per_month = sums.select(*by, "label", "period", F.inline_outer(values))
    months = per_month.groupBy(*by, "metric", "label").agg(
        F.coalesce(F.sum("v"), F.lit(0)).alias("total"),
        F.map_from_entries(F.collect_list(F.struct("period", "v"))).alias("by_month"),  # one entry per month
    )
    top = ranked(months, n, [F.desc("total"), "label"], by=[*by, "metric"])
    calendar = F.array(*[F.lit(x) for x in labels])
    return top.select(*by, "metric", "rank", "label", dbl("total").alias("total"), "by_month", F.explode(calendar).alias("period")).select(
        *by, "metric", "rank", "label", "total", "period",
        dbl(F.coalesce(F.try_element_at("by_month", F.col("period")), F.lit(0))).alias("value"),
    )


def interactive_cube(rows: DataFrame, labels: list[str], dimensions=CUBE_DIMENSIONS, metrics=CUBE_METRICS, n: int = 12) -> DataFrame:
    """Month values per metric and dimension for the 12 largest labels."""
    present = rows.select("period", *dimensions, *[metric_value(m).alias(m) for m in metrics])
    return _filled_series(unpivot_dimensions(present, dimensions, ["period", *metrics]), ["dimension"], metrics, labels, n)


def cube_totals(rows: DataFrame, labels: list[str], metrics=CUBE_METRICS) -> DataFrame:
    sums = rows.groupBy("period").agg(*[F.sum(metric_value(m)).alias(m) for m in metrics])
    values = F.array(*[F.struct(F.lit(m).alias("metric"), dbl(F.coalesce(F.col(m), F.lit(0))).alias("value")) for m in metrics])
    months = literal_rows(rows.sparkSession, ["period"], [(x,) for x in labels])
    return months.join(sums, "period", "left").select("period", F.inline_outer(values))


def metric_value(metric: str) -> Column:
    """A measure of the cube with its fallback chain."""
    if metric == "amount_net":
        return F.coalesce("amount_net", "amount", F.lit(0))
    if metric == "amount_final":
        return F.coalesce("amount_final", "amount", F.lit(0))
    if metric == "amount_net_internal":
        return F.coalesce(F.col("amount_net_internal"), metric_value("amount_net") + F.coalesce("internal_taxes", F.lit(0)))
    return F.coalesce(metric, F.lit(0))


# --- rankings -------------------------------------------------------------------------------

# Ranking lists over dimensions: list, dimension, metric.
RANKING_LISTS = (
    ("vendedores_importe", "seller_name", "sales"), ("vendedores_unidades", "seller_name", "quantity"),
    ("productivos_importe", "seller_name", "avg_order_value"), ("productivos_unidades", "seller_name", "avg_units_per_order"),
    ("fuerzas_importe", "sales_force", "sales"), ("fuerzas_unidades", "sales_force", "quantity"),
    ("rutas_importe", "route_description", "sales"), ("rutas_unidades", "route_description", "quantity"),
    ("marcas_importe", "brand", "sales"), ("marcas_unidades", "brand", "quantity"),
    ("unidades_negocio_importe", "business_unit", "sales"), ("unidades_negocio_unidades", "business_unit", "quantity"),
    ("canales_importe", "channel", "sales"), ("canales_unidades", "channel", "quantity"),
)


def rankings(clients: DataFrame, dimensions: DataFrame, n: int = 10) -> DataFrame:
    """Top lists by sales and by units, plus the clients most at risk."""
    lists = ranked(_list_rows(dimensions, RANKING_LISTS), n, [F.desc("value"), "label"], by=["list"])
    by_value = clients.select(
        "client_key", "client",
        F.inline_outer(F.array(
            F.struct(F.lit("clientes_importe").alias("list"), exact("sales").alias("value")),
            F.struct(F.lit("clientes_unidades").alias("list"), exact("quantity").alias("value")),
        )),
    )
    top = ranked(by_value, n, [F.desc("value"), "client_key"], by=["list"]).select("list", F.col("client").alias("label"), "value", "rank")
    risk = ranked(clients, n, [status_rank(), F.desc("history_sales"), "client_key"])
    risk = risk.select(F.lit("clientes_riesgo").alias("list"), F.col("client").alias("label"), F.col("history_sales").alias("value"), "rank")
    return lists.select("list", "rank", "label", "value").unionByName(top.select("list", "rank", "label", "value")).unionByName(risk.select("list", "rank", "label", "value"))


# --- insight and action triggers ------------------------------------------------------------


def report_triggers(base: ReportBase) -> DataFrame:
    """Which insights and actions apply, with the figure each one states."""
    opp = one_row(opportunity_totals(base), F.max(F.struct("recover_dormant", "cross_sell", "route_optimization")).alias("o")).o
    s = one_row(base.summary, F.max(F.struct(
        "volume_mode", "units_growth_pct", "sales_growth_pct", "units_per_seller", "sales_per_seller", "top_brand_pct", "route_pct", "article_pct")).alias("s")).s
    cov = one_row(base.figures, F.max(F.struct("cov.sales_without_route", "cov.sales_without_article")).alias("c")).c
    f = one_row(base.forecast, F.max(F.struct("projected_sales", "projected_units")).alias("f")).f
    n_alerts = one_row(alerts(base), F.count("*").alias("n")).n
    row = base.fact.sparkSession.range(1).select(opp.alias("o"), s.alias("s"), cov.alias("c"), f.alias("f"), n_alerts.alias("n"))
    volume = F.col("s.volume_mode")
    pick = lambda a, b: F.when(volume, F.col(a)).otherwise(F.col(b))
    yes = F.lit(True)
    rules = [
        (("insight", "evolución"), yes, pick("s.units_growth_pct", "s.sales_growth_pct"), _none()),
        (("insight", "productividad"), yes, pick("s.units_per_seller", "s.sales_per_seller"), _none()),
        (("insight", "mix"), yes, F.col("s.top_brand_pct"), _none()),
        (("insight", "calidad de datos"), yes, F.col("s.route_pct"), _none()),
        (("insight", "proyección"), yes, pick("f.projected_units", "f.projected_sales"), _none()),
        (("insight", "palancas"), yes, F.col("o.recover_dormant"), _none()),
        (("acción", "recuperar cartera"), F.round("o.recover_dormant", 2) > 0, F.col("o.recover_dormant"), _none()),
        (("acción", "profundizar surtido"), F.round("o.cross_sell", 2) > 0, F.col("o.cross_sell"), _none()),
        (("acción", "depurar rutas"), to_tenth("s.route_pct") < 95, F.col("c.sales_without_route"), _none()),
        (("acción", "completar artículos"), to_tenth("s.article_pct") < 95, F.col("c.sales_without_article"), _none()),
        (("acción", "revisar proyección"), yes, F.col("f.projected_sales"), _none()),
        (("acción", "atender alerta"), F.col("n") > 0, F.col("n"), _none()),
    ]
    return _rule_rows(row, rules, ["kind", "topic"]).filter("fires").select("rule", "kind", "topic", "value")


def dataset_meta(sources: DataFrame) -> DataFrame:
    """Rows read and valid per dataset and source, from rows tagged with dataset, source and validity."""
    return sources.groupBy("dataset", "source").agg(
        F.count("*").alias("rows_read"), F.count_if("is_valid").alias("rows_valid"))
