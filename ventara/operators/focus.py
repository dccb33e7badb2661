"""Seller and client dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ventara.functions.numbers import dbl, pct_change_abs, ratio, share_pct, to_tenth
from ventara.functions.text import first_text, folded, label_of
from ventara.operators.core import amount_where, client_id, invoice_id, one_row, ranked, status_rank, usual_values, weight
from ventara.plans.period import Period

NO_SELLER = "Sin vendedor"


def _exact(c):
    return F.col(c).cast("decimal(38,6)")


def sellers_dashboard(fact: DataFrame, period: Period) -> DataFrame:
    """Seller rows: sales against the comparison, clients won and lost, dependence on three clients, status."""
    cur, prev = F.col("cur"), F.col("prev")
    rows = fact.select(
        label_of("seller_name").alias("seller"), client_id().alias("client"), invoice_id().alias("invoice"), "amount", "quantity",
        label_of("sales_force").alias("force"), label_of("route_description").alias("route"),
        period.in_selected().alias("cur"), period.in_comparison().alias("prev"), weight(fact).alias("w"),
    ).filter(cur | prev)
    total = one_row(rows.filter(cur), F.coalesce(F.sum("amount"), F.lit(0)).alias("t")).t
    base = rows.groupBy("seller").agg(
        amount_where(cur).alias("sales"), amount_where(prev).alias("previous_sales"), amount_where(cur, "quantity").alias("quantity"),
        F.count_distinct(F.when(cur, F.col("invoice"))).alias("orders"),
    )
    # Usual force and route of the selected period, else of the comparison.
    combos = rows.groupBy("seller", "force", "route", "cur").agg(F.sum("w").alias("n"))
    usual = usual_values(combos, "seller", ("force", "route"), "cur")
    pairs = rows.filter(F.col("client").isNotNull()).groupBy("seller", "client").agg(
        amount_where(cur).alias("value"), F.bool_or("cur").alias("in_cur"), F.bool_or("prev").alias("in_prev"))
    moves = pairs.groupBy("seller").agg(
        F.count_if("in_cur").alias("clients"), F.count_if("in_prev").alias("previous_clients"),
        F.count_if(F.col("in_cur") & ~F.col("in_prev")).alias("recovered_clients"),
        F.count_if(F.col("in_prev") & ~F.col("in_cur")).alias("dropped_clients"),
    )
    top3 = ranked(pairs.filter("in_cur").select("seller", "client", "value"), 3, [F.desc("value"), "client"], by=["seller"])
    top3 = top3.groupBy("seller").agg(F.sum("value").alias("top3"))
    joined = base.join(usual, "seller").join(moves, "seller", "left").join(top3, "seller", "left").na.fill(
        0, ["clients", "previous_clients", "recovered_clients", "dropped_clients"])
    growth, delta = to_tenth(pct_change_abs("sales", "previous_sales")), F.col("clients") - F.col("previous_clients")
    status = F.when((growth <= -12) | (delta <= -6), "En riesgo").when((growth >= 5) & (delta >= 0), "Sólido").otherwise("Atento")
    return joined.select(
        "seller", dbl("sales").alias("sales"), dbl("previous_sales").alias("previous_sales"), pct_change_abs("sales", "previous_sales").alias("growth_pct"),
        dbl("quantity").alias("quantity"), "clients", delta.alias("client_delta"), "orders",
        ratio("sales", "orders").alias("avg_ticket"), ratio("quantity", "orders").alias("avg_units_per_order"), ratio("sales", "clients").alias("sales_per_client"),
        share_pct("sales", total).alias("share_pct"), "recovered_clients", "dropped_clients",
        share_pct(F.coalesce("top3", F.lit(0)), "sales").alias("top3_clients_pct"), F.col("force").alias("sales_force"), F.col("route").alias("route"),
        status.alias("status"),
    )


def _weak(total):
    return (to_tenth("growth_pct") <= -12) & (_exact("sales") >= total * 0.015) & (F.col("seller") != NO_SELLER)


def sellers_summary(sellers: DataFrame) -> DataFrame:
    """Counts, averages and dependence over the real sellers."""
    total = one_row(sellers, F.sum(_exact("sales")).alias("t"), F.sum(_exact("quantity")).alias("q"))
    real = sellers.filter(F.col("seller") != NO_SELLER)
    top = ranked(real.select("seller", _exact("sales").alias("v")), 3, [F.desc("v"), "seller"])
    light = (F.col("clients") <= 15) & (_exact("sales") < total.t * 0.01)
    row = real.agg(
        F.count("*").alias("sellers"), F.sum("clients").alias("clients"), F.count_if(_weak(total.t)).alias("weak_sellers"),
        F.count_if(light).alias("light_portfolios"), F.sum("recovered_clients").alias("recovered_clients"), F.sum("dropped_clients").alias("dropped_clients"),
    )
    return row.select(
        "sellers", ratio(total.t, "sellers").alias("sales_per_seller"), ratio(total.q, "sellers").alias("units_per_seller"),
        ratio("clients", "sellers").alias("clients_per_seller"),
        share_pct(one_row(top, F.coalesce(F.sum("v"), F.lit(0)).alias("s")).s, total.t).alias("top3_pct"),
        "weak_sellers", "light_portfolios", "recovered_clients", "dropped_clients",
    )


def sellers_alerts(sellers: DataFrame) -> DataFrame:
    """Dependence, worst falling seller, light portfolios."""
    total = one_row(sellers, F.sum(_exact("sales")).alias("t")).t
    worst = one_row(sellers.filter(_weak(total)), F.min(F.struct("growth_pct", "seller")).alias("w")).w
    row = sellers_summary(sellers).withColumn("w", worst)
    rules = [
        ("dependencia", to_tenth("top3_pct") >= 55, F.col("top3_pct"), F.lit(None).cast("string")),
        ("vendedor en caída", F.col("w").isNotNull(), F.col("w.growth_pct"), F.col("w.seller")),
        ("cartera liviana", F.col("light_portfolios") > 0, dbl("light_portfolios"), F.lit(None).cast("string")),
    ]
    structs = F.array(*[
        F.when(fires, F.struct(F.lit("sellers").alias("board"), F.lit("warn").alias("severity"), F.lit(t).alias("topic"), v.alias("value"), l.alias("label")))
        for t, fires, v, l in rules
    ])
    return row.select(F.inline_outer(F.filter(structs, lambda x: x.isNotNull()))).filter(F.col("topic").isNotNull())


def sellers_charts(sellers: DataFrame) -> DataFrame:
    """Top sales, falls and rises, widest portfolios and strongest dependence."""
    real = sellers.filter(F.col("seller") != NO_SELLER)
    slices = [
        ("venta", sellers, 8, "sales", True), ("caídas", real, 8, "growth_pct", False), ("subas", real, 4, "growth_pct", True),
        ("clientes", real, 8, "clients", True), ("concentración", real, 8, "top3_clients_pct", True),
    ]
    frames = [
        ranked(df.select("seller", dbl(m).alias("value")), n, [F.desc("value") if down else F.asc("value"), "seller"]).select(F.lit(name).alias("chart"), "rank", "seller", "value")
        for name, df, n, m, down in slices
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def clients_dashboard(fact: DataFrame, period: Period, clients: DataFrame) -> DataFrame:
    """Clients merged by normalised name, with their lifecycle in the period."""
    key = folded(F.coalesce(first_text("client"), F.col("client_key")))
    merged = clients.withColumn("client_id", key).groupBy("client_id").agg(
        F.max_by("client", F.struct("sales", "client", "client_key")).alias("client"),
        F.min(status_rank()).alias("worst"),
        *[F.sum(_exact(c)).alias(c) for c in ("sales", "previous_sales", "history_sales", "quantity")],
        F.sum("orders").alias("orders"), F.max("families").alias("families"), F.max("last_date").alias("last_date"), F.min("recency_days").alias("recency_days"),
        *[F.mode(c, True).alias(c) for c in ("sales_force", "route_description", "seller_name")],
    )
    buying = fact.filter(period.in_selected()).select(client_id().alias("client_id")).filter(F.col("client_id").isNotNull()).distinct().withColumn("buys", F.lit(True))
    total = one_row(clients, F.coalesce(F.sum(_exact("sales")), F.lit(0)).alias("t")).t
    status = F.when(F.col("worst") == 0, "Perdido").when(F.col("worst") == 1, "Reactivable").when(F.col("worst") == 2, "Dormido").otherwise("Activo")
    back = F.coalesce("buys", F.lit(False)) & (F.col("previous_sales") <= 0)
    lifecycle = F.when(back & (F.col("history_sales") > F.col("sales")), "Recuperado").when(back, "Nuevo").otherwise(status)
    return merged.join(buying, "client_id", "left").select(
        "client", "client_id", lifecycle.alias("status"), dbl("sales").alias("sales"), dbl("previous_sales").alias("previous_sales"),
        pct_change_abs("sales", "previous_sales").alias("growth_pct"), dbl("quantity").alias("quantity"),
        ratio("sales", "orders").alias("avg_ticket"), ratio("quantity", "orders").alias("avg_units_per_order"), "families", "last_date",
        "sales_force", F.col("route_description").alias("route"), F.col("seller_name").alias("seller"), "recency_days", share_pct("sales", total).alias("share_pct"),
    )


def _active():
    return F.col("status").isin("Activo", "Recuperado", "Nuevo") & (F.col("sales") > 0)


def _at_risk():
    return F.col("status").isin("Dormido", "Reactivable", "Perdido")


def lifecycle_counts(dashboard: DataFrame) -> DataFrame:
    return dashboard.groupBy("status").agg(F.count("*").alias("clients"))


def not_repurchased(fact: DataFrame, period: Period) -> DataFrame:
    """Clients of the comparison period without a purchase in the selected one."""
    cur, prev = period.in_selected(), period.in_comparison()
    flags = fact.filter(cur | prev).groupBy(client_id().alias("client")).agg(F.bool_or(cur).alias("in_cur"), F.bool_or(prev).alias("in_prev"))
    return flags.filter(F.col("client").isNotNull()).agg(F.count_if(F.col("in_prev") & ~F.col("in_cur")).alias("not_repurchased"))


def clients_summary(fact: DataFrame, period: Period, dashboard: DataFrame) -> DataFrame:
    total = one_row(dashboard, F.coalesce(F.sum(_exact("sales")), F.lit(0)).alias("t")).t
    top = ranked(dashboard.select("client_id", _exact("sales").alias("v")), 10, [F.desc("v"), "client_id"])
    row = dashboard.agg(
        F.count_if(_active()).alias("active"), F.count_if(_at_risk()).alias("at_risk"),
        F.count_if(F.col("status") == "Recuperado").alias("recovered"), F.count_if(F.col("status") == "Nuevo").alias("new"),
        F.coalesce(F.sum(F.when(_active(), F.round("avg_ticket", 2).cast("decimal(28,2)"))), F.lit(0)).alias("tickets"),
    )
    return row.select(
        "active", "at_risk", "recovered", "new",
        share_pct(one_row(top, F.coalesce(F.sum("v"), F.lit(0)).alias("s")).s, total).alias("top10_pct"),
        ratio("tickets", "active").alias("avg_ticket"),
        one_row(not_repurchased(fact, period), F.max("not_repurchased").alias("n")).n.alias("not_repurchased"),
    )


def clients_alerts(summary: DataFrame, dashboard: DataFrame, clients: DataFrame) -> DataFrame:
    """Concentration, clients without repurchase, narrow assortments and the largest account at risk."""
    risk = one_row(dashboard.filter(_at_risk()), F.max_by(F.struct("client", "recency_days"), F.struct("sales", "client_id")).alias("r")).r
    low = one_row(clients, F.count_if((F.col("status") == "Activo") & (F.col("families") <= 1)).alias("n")).n
    row = summary.withColumn("r", risk).withColumn("low", low)
    none = F.lit(None).cast("string")
    rules = [
        ("concentración", "warn", to_tenth("top10_pct") >= 45, F.col("top10_pct"), none),
        ("sin recompra", "warn", F.col("not_repurchased") >= 120, dbl("not_repurchased"), none),
        ("mix corto", "warn", F.col("low") >= 25, dbl("low"), none),
        ("cuenta en riesgo", "critical", F.col("r").isNotNull(), dbl("r.recency_days"), F.col("r.client")),
    ]
    structs = F.array(*[
        F.when(fires, F.struct(F.lit("clients").alias("board"), F.lit(s).alias("severity"), F.lit(t).alias("topic"), v.alias("value"), l.alias("label")))
        for t, s, fires, v, l in rules
    ])
    return row.select(F.inline_outer(F.filter(structs, lambda x: x.isNotNull()))).filter(F.col("topic").isNotNull())
