"""The ten analyses a user can ask for by name."""

from __future__ import annotations

from datetime import date
from functools import partial, reduce

from pyspark.sql import DataFrame, Window, functions as F

from ventara.functions.numbers import dbl, moderated, pct_change, ratio, share_pct
from ventara.functions.text import clean
from ventara.operators.core import (
    amount_where, client_status, money, one_row, purchase_gaps, ranked, status_rank, usual_values, weight,
)
from ventara.plans.session import kept

# Routes counted as not covered.
UNCOVERED_ROUTES = ("", "sin ruta")


def _clients():
    return F.count_distinct(clean("client_key"))


def _orders():
    return F.count_distinct(clean("invoice"))


# --- temporal trend -------------------------------------------------------------------------


def temporal_trend(fact: DataFrame, metric: str = "amount") -> DataFrame:
    """Month sums of a measure over the months that exist."""
    return fact.groupBy("period").agg(money(metric).alias("value"))


def temporal_trend_by(fact: DataFrame, dimension: str, metric: str = "amount") -> DataFrame:
    """Month sums per label, with zero where a label has no sales in a month that exists.

    The months come as one array (one entry per calendar month), so the fill is an explode and
    not a join of labels with months.
    """
    sums = fact.groupBy(clean(dimension).alias("label"), "period").agg(F.sum(metric).alias("value"))
    months = one_row(fact.select("period"), F.sort_array(F.collect_set("period")).alias("months")).months
    return (
        sums.groupBy("label")
        .agg(F.map_from_entries(F.collect_list(F.struct("period", "value"))).alias("by_month"))
        .select("label", "by_month", F.explode(months).alias("period"))
        .select("label", "period", dbl(F.coalesce(F.try_element_at("by_month", F.col("period")), F.lit(0))).alias("value"))
    )


def trend_outlook(fact: DataFrame, metric: str = "amount") -> DataFrame:
    """Averages of the last three and the three earlier months, trend and projection for three months."""
    months = fact.groupBy("period").agg(F.sum(metric).alias("value"))
    back = F.row_number().over(Window.orderBy(F.desc("period")))  # one row per calendar month
    last3, prev3 = F.col("back") <= 3, F.col("back").between(4, 6)
    # With fewer than six months everything before the last three is the base.
    row = months.withColumn("back", back).agg(
        F.count("*").alias("periods"),
        F.max("period").alias("last_period"),
        F.sum(F.when(last3, F.col("value"))).alias("last_sum"),
        F.count_if(last3).alias("last_n"),
        F.sum(F.when(prev3, F.col("value"))).alias("prev_sum"),
        F.count_if(prev3).alias("prev_n"),
    )
    last_avg = dbl("last_sum") / F.nullif(dbl("last_n"), F.lit(0.0))
    row = row.withColumn("last3_avg", F.coalesce(last_avg, F.lit(0.0))).withColumn(
        "prev3_avg", F.coalesce(dbl("prev_sum") / F.nullif(dbl("prev_n"), F.lit(0.0)), F.col("last3_avg"))
    )
    row = row.withColumn("trend_pct", pct_change("last3_avg", "prev3_avg"))
    first = F.to_date(F.concat("last_period", F.lit("-01")))
    step = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("step")
    return row.select("*", step).select(
        "periods", "last3_avg", "prev3_avg", "trend_pct",
        F.date_format(F.add_months(first, F.col("step")), "yyyy-MM").alias("forecast_period"),
        (F.col("last3_avg") * moderated("trend_pct")).alias("forecast"),
    )


# --- rankings -------------------------------------------------------------------------------


def _ranking_items(fact: DataFrame, key, metric: str) -> DataFrame:
    return fact.groupBy(key.alias("label")).agg(
        F.coalesce(F.sum(metric), F.lit(0)).alias("exact"), _clients().alias("clients"), _orders().alias("orders")
    )


def dimension_ranking(fact: DataFrame, dim_a: str, dim_b: str | None = None, metric: str = "amount", top_n: int = 20) -> DataFrame:
    """Largest labels of one dimension or a pair, with share of the grand total, clients and orders."""
    key = clean(dim_a) if dim_b is None else F.concat(clean(dim_a), F.lit(" / "), clean(dim_b))
    grand = one_row(fact, F.sum(metric).alias("total"))
    top = ranked(_ranking_items(fact, key, metric), top_n, [F.desc("exact"), "label"])
    return top.select(
        "rank", "label", dbl("exact").alias("value"),
        share_pct("exact", grand.total).alias("share_pct"), "clients", "orders",
    )


def ranking_concentration(fact: DataFrame, dimension: str, metric: str = "amount", top_n: int = 20) -> DataFrame:
    """Total, top-three share and Herfindahl index over the listed labels and over all of them."""
    return concentration_of(fact.groupBy(clean(dimension).alias("label")).agg(F.sum(metric).alias("exact")), top_n)


def concentration_of(items: DataFrame, top_n: int = 20) -> DataFrame:
    """The same from sums (label, exact)."""
    grand = one_row(items, F.sum("exact").alias("total"))
    share = ratio("exact", grand.total)
    squares = items.agg((F.sum(share * share) * 10000).alias("hhi"))
    top = ranked(items, top_n, [F.desc("exact"), "label"])
    return top.agg(
        dbl(F.max(grand.total)).alias("total"),
        F.sum(F.when(F.col("rank") <= 3, F.col("exact"))).alias("top3"),
        (F.sum(share * share) * 10000).alias("hhi_top"),
    ).select(
        "total", share_pct("top3", "total").alias("top3_pct"), "hhi_top",
        one_row(squares, F.max("hhi").alias("hhi")).hhi.alias("hhi_all"),
    )


def _distinct_in_sets(rows: DataFrame, dimensions, sets, ids) -> DataFrame:
    """(set_id, dimensions, a count of each id): distinct ids of the labels of each set, where dimensions that are not of the set are NULL.

    Clients and orders with their labels are made distinct once, for all sets. Most of them vary in one dimension at most, as an order of one
    client does: each of its rows then counts in the sets with that dimension, and one of them in the others. Rows of the rest are repeated
    for each set and made distinct there.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in enumerate(ids)])
    held = rows.select(*dimensions, F.inline(pairs)).distinct()
    one = Window.partitionBy("kind", "id")
    varies = [F.min(d).over(one) != F.max(d).over(one) for d in dimensions]
    marked = held.select("*", F.array(*varies).alias("varies"), (F.row_number().over(one.orderBy(*dimensions)) == 1).alias("first"))
    plain = F.size(F.filter("varies", lambda x: x)) <= 1
    masked = lambda s: [F.when(F.lit(d in s), F.col(d)).alias(d) for d in dimensions]
    whole = F.struct(F.lit(-1).alias("set_id"), F.lit(None).cast("string").alias("id"), *masked(dimensions))
    apart = [F.struct(F.lit(i).alias("set_id"), F.col("id").alias("id"), *masked(s)) for i, s in enumerate(sets)]
    spread = marked.select("kind", "first", F.when(plain, F.col("varies")).alias("varies"), F.inline(F.when(plain, F.array(whole)).otherwise(F.array(*apart))))
    tallied = spread.groupBy("kind", "set_id", "id", "varies", *dimensions).agg(F.count("*").alias("rows"), F.count_if("first").alias("ones"))
    # A plain id counts in every set; an id that was made distinct there once in its own.
    counts = []
    for i, s in enumerate(sets):
        inside = reduce(lambda x, y: x | y, [F.col("varies")[dimensions.index(d)] for d in s])
        counts.append(F.when(F.col("set_id") == -1, F.struct(F.lit(i).alias("set_id"), F.when(inside, F.col("rows")).otherwise(F.col("ones")).alias("n"), *masked(s))))
    own = F.when(F.col("set_id") >= 0, F.struct("set_id", F.lit(1).cast("long").alias("n"), *dimensions))
    flat = tallied.select("kind", F.inline(F.filter(F.array(*counts, own), lambda x: x.isNotNull())))
    return flat.groupBy("set_id", *dimensions).agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(c) for k, c in enumerate(ids)])


def ranking_all_combos(fact: DataFrame, dimensions, metric: str = "amount", top_n: int = 20) -> DataFrame:
    """Rankings of every single dimension and every pair of them, from one sum by all dimensions and one distinct count of ids."""
    singles = [(d,) for d in dimensions]
    pairs = [(a, b) for i, a in enumerate(dimensions) for b in dimensions[i + 1:]]
    sets = singles + pairs
    rows = fact.select(*[clean(d).alias(d) for d in dimensions], clean("client_key").alias("clients"), clean("invoice").alias("orders"), F.col(metric).alias("metric"))
    masked = lambda s: [F.when(F.lit(d in s), F.col(d)).alias(d) for d in dimensions]
    cube = rows.groupBy(*dimensions).agg(F.sum("metric").alias("sum"))
    spread = cube.select("sum", F.inline(F.array(*[F.struct(F.lit(i).alias("set_id"), *masked(s)) for i, s in enumerate(sets)])))
    sums = spread.groupBy("set_id", *dimensions).agg(F.coalesce(F.sum("sum"), F.lit(0)).alias("exact"))
    counts = _distinct_in_sets(rows, list(dimensions), sets, ("clients", "orders"))
    same = reduce(lambda x, y: x & y, [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("set_id", *dimensions)])
    grouped = sums.alias("s").join(counts.alias("c"), same).select("s.*", "c.clients", "c.orders")
    combo = F.element_at(F.array(*[F.lit(" / ".join(s)) for s in sets]), F.col("set_id") + 1)
    label = F.concat_ws(" / ", *[F.col(d) for d in dimensions])
    grand = one_row(cube, F.sum("sum").alias("total"))
    items = grouped.select(combo.alias("combo"), label.alias("label"), "exact", "clients", "orders")
    top = ranked(items, top_n, [F.desc("exact"), "label"], by=["combo"])
    return top.select(
        "combo", "rank", "label", dbl("exact").alias("value"),
        share_pct("exact", grand.total).alias("share_pct"), "clients", "orders",
    )


# --- recurrence and churn -------------------------------------------------------------------


def churn_clients(fact: DataFrame, client: str = "client_key", metric: str = "amount", segment: str | None = None) -> DataFrame:
    """Recency, status, twelve-month sales and buying frequency per client."""
    has_client = clean(client) != ""
    last = one_row(fact, F.max("date").alias("day")).day
    rows = fact.filter(has_client).select(
        clean(client).alias("client_key"), "client", "date", "period", F.col(metric).alias("metric"),
        F.coalesce(F.nullif(clean("invoice"), F.lit("")), F.col("date").cast("string")).alias("order"),
        (clean(segment) if segment else F.lit(None).cast("string")).alias("segment"),
        F.coalesce(F.col("date") >= F.date_sub(last, 364), F.lit(False)).alias("recent"), weight(fact).alias("w"),
    )
    sums = rows.groupBy("client_key").agg(
        F.coalesce(F.sum(F.when(F.col("recent"), F.col("metric"))), F.lit(0)).alias("sales12"),
        F.coalesce(F.sum("metric"), F.lit(0)).alias("sales_all"),
        F.count_distinct(F.when(F.col("recent"), F.col("order"))).alias("orders12"),
        F.count_distinct("order").alias("orders_all"),
        F.count_distinct(F.when(F.col("recent"), F.col("period"))).alias("months_active"),
    )
    combos = rows.groupBy("client_key", "client", "segment").agg(F.sum("w").alias("n"), F.max("date").alias("date"))
    names = combos.groupBy("client_key").agg(F.coalesce(F.max(F.struct("date", "client")).client, F.col("client_key")).alias("client"))
    sums = sums.join(names, "client_key").join(usual_values(combos, "client_key", ["segment"]), "client_key")
    gaps = purchase_gaps(rows.filter(F.col("date").isNotNull()))
    orders = F.when(F.col("orders12") > 0, F.col("orders12")).otherwise(F.col("orders_all"))
    dated = F.col("last_date").isNotNull()
    recency = F.when(dated, F.date_diff(last, "last_date")).otherwise(F.lit(9999))
    gap = F.when(dated, F.col("avg_gap_days")).otherwise(F.lit(60.0))
    status = F.when(dated, client_status(recency, gap)).otherwise(F.lit("Perdido"))
    return sums.join(gaps, "client_key", "left").select(
        "client_key", "client", status.alias("status"),
        dbl("sales12").alias("sales12m"), dbl("sales_all").alias("history_sales"),
        "last_date", recency.cast("long").alias("recency_days"), gap.alias("avg_gap_days"), "months_active",
        (dbl("orders12") / 12).alias("monthly_frequency"),
        ratio("sales_all", orders).alias("avg_ticket"),
        orders.alias("orders"), "orders12", "segment",
    )


def churn_risk_list(clients: DataFrame, n: int = 50) -> DataFrame:
    """Clients ordered by risk, then by historic sales."""
    return ranked(clients, n, [status_rank(), F.desc("history_sales"), "client_key"])


def churn_status(clients: DataFrame) -> DataFrame:
    return clients.groupBy("status").agg(
        F.count("*").alias("clients"),
        dbl(F.sum(F.col("sales12m").cast("decimal(38,6)"))).alias("sales12m"),
    )


def churn_summary(clients: DataFrame) -> DataFrame:
    """Portfolio row: active and recurring share, frequencies, mean ticket and sales at risk."""
    buyer = F.col("orders12") > 0
    at_risk = F.col("status").isin("Dormido", "Reactivable")
    row = clients.agg(
        F.count("*").alias("total_clients"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (
            ("Activo", "active"), ("Dormido", "dormant"), ("Reactivable", "reactivable"), ("Perdido", "lost"))],
        F.count_if(F.col("months_active") >= 4).alias("recurring"),
        F.coalesce(F.sum(F.when(buyer, F.col("orders12"))), F.lit(0)).alias("orders12m"),
        F.count_if(buyer).alias("buyers12m"),
        dbl(F.avg(F.round("avg_ticket", 2).cast("decimal(28,2)"))).alias("avg_ticket"),
        dbl(F.coalesce(F.sum(F.when(at_risk, F.col("history_sales").cast("decimal(38,6)"))), F.lit(0))).alias("at_risk_sales"),
    )
    return row.select(
        "*",
        share_pct("active", "total_clients").alias("active_pct"),
        share_pct("recurring", "total_clients").alias("recurring_pct"),
        share_pct(F.col("dormant") + F.col("reactivable") + F.col("lost"), "total_clients").alias("churn_pct"),
        ratio(dbl("orders12m") / 12, "buyers12m").alias("monthly_frequency"),
        ratio(dbl("orders12m") / 12, "total_clients").alias("monthly_frequency_universe"),
    )


# --- assortment -----------------------------------------------------------------------------


def client_breadth(fact: DataFrame, client: str = "client_key", product: str = "family", metric: str = "amount") -> DataFrame:
    """Number of distinct categories and value per client, counted per (client, category) first."""
    return _breadth(_bought(fact, client, product, metric))


def _bought(fact: DataFrame, client: str, product: str, metric: str) -> DataFrame:
    rows = fact.select(clean(client).alias("client"), clean(product).alias("category"), F.col(metric).alias("metric"))
    rows = rows.filter((F.col("client") != "") & (F.col("category") != ""))
    return rows.groupBy("client", "category").agg(F.sum("metric").alias("exact"))


def _breadth(bought: DataFrame) -> DataFrame:
    return bought.groupBy("client").agg(F.count("*").alias("breadth"), dbl(F.sum("exact")).alias("value"))


def cross_sell_mix(fact: DataFrame, n: int = 50, client: str = "client_key", product: str = "family", metric: str = "amount") -> DataFrame:
    """The n clients with most categories; only theirs are listed."""
    bought = _bought(fact, client, product, metric)
    top = ranked(_breadth(bought), n, [F.desc("breadth"), F.desc("value"), "client"])
    listed = bought.join(F.broadcast(top.select("client")), "client", "left_semi").groupBy("client").agg(F.sort_array(F.collect_list("category")).alias("categories"))  # n rows on the right
    return top.join(listed, "client")


def breadth_distribution(breadth: DataFrame) -> DataFrame:
    return breadth.groupBy("breadth").agg(F.count("*").alias("clients"))


def breadth_summary(breadth: DataFrame) -> DataFrame:
    """Mean breadth and the clients buying one category or none; the share is over all clients."""
    row = breadth.agg(
        F.count("*").alias("clients"),
        F.coalesce(dbl(F.sum("breadth")) / F.nullif(dbl(F.count("*")), F.lit(0.0)), F.lit(0.0)).alias("avg_breadth"),
        F.count_if(F.col("breadth") <= 1).alias("low_breadth_clients"),
        F.coalesce(F.max("breadth"), F.lit(1)).alias("max_breadth"),
    )
    return row.withColumn("low_breadth_pct", share_pct("low_breadth_clients", "clients"))


# --- performance by label -------------------------------------------------------------------


def performance(fact: DataFrame, dimension: str, metric: str = "amount", last_day: date | None = None) -> DataFrame:
    """Value, share, clients, orders and growth of the last 90 days over the 90 before, per label.

    Rows without a label are left out, and so is their value from the total.
    """
    last = F.lit(last_day) if last_day else one_row(fact, F.max("date").alias("day")).day
    rows = fact.filter(clean(dimension) != "")
    recent = F.col("date") >= F.date_sub(last, 89)
    before = F.col("date").between(F.date_sub(last, 179), F.date_sub(last, 90))
    grand = one_row(rows, F.sum(metric).alias("total"))
    stats = rows.groupBy(clean(dimension).alias("label")).agg(
        F.coalesce(F.sum(metric), F.lit(0)).alias("exact"),
        amount_where(recent, metric).alias("recent"),
        amount_where(before, metric).alias("before"),
        _clients().alias("clients"),
        _orders().alias("orders"),
    )
    return stats.select(
        "label", dbl("exact").alias("value"), share_pct("exact", grand.total).alias("share_pct"),
        "clients", "orders", pct_change("recent", "before").alias("growth_pct"),
    )


seller_performance = partial(performance, dimension="seller_name")
sales_force_breakdown = partial(performance, dimension="sales_force")
product_analysis = partial(performance, dimension="family")


def performance_summary(stats: DataFrame) -> DataFrame:
    """Total, number of labels, leader, top-three share and how many labels grow or decline."""
    exact = F.col("value").cast("decimal(38,6)")
    top = ranked(stats.select("label", "share_pct", "growth_pct", exact.alias("exact")), 3, [F.desc("exact"), "label"])
    head = one_row(
        top,
        F.sum("exact").alias("top3"),
        F.min_by("label", "rank").alias("leader"),
        F.min_by("share_pct", "rank").alias("leader_share_pct"),
        F.min_by("growth_pct", "rank").alias("leader_growth_pct"),
    )
    return stats.agg(
        dbl(F.sum(exact)).alias("total"),
        F.count("*").alias("labels"),
        F.count_if(F.round("growth_pct", 1) > 5).alias("growing"),
        F.count_if(F.round("growth_pct", 1) < -10).alias("declining"),
        F.count_if(F.round("growth_pct", 1) < 0).alias("falling"),
        F.count_if(F.round("growth_pct", 1) >= 10).alias("growing_strongly"),
        F.count_if(F.round("growth_pct", 1) < -5).alias("declining_notably"),
        F.max("value").alias("max_value"),
        F.min("value").alias("min_value"),
    ).select(
        "*", share_pct(head.top3, "total").alias("top3_pct"), head.leader.alias("leader"),
        head.leader_share_pct.alias("leader_share_pct"), head.leader_growth_pct.alias("leader_growth_pct"),
    )


def channel_analysis(fact: DataFrame, dimension: str = "channel", metric: str = "amount") -> DataFrame:
    """Value, share and clients per channel."""
    rows = fact.filter(clean(dimension) != "")
    grand = one_row(rows, F.sum(metric).alias("total"))
    stats = rows.groupBy(clean(dimension).alias("label")).agg(F.sum(metric).alias("exact"), _clients().alias("clients"))
    return stats.select("label", dbl("exact").alias("value"), share_pct("exact", grand.total).alias("share_pct"), "clients")


def channel_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("channels"),
        dbl(F.sum(F.col("value").cast("decimal(38,6)"))).alias("total"),
        F.max(F.struct("value", "label", "share_pct")).alias("top"),
    ).select("channels", "total", F.col("top.label").alias("leader"), F.col("top.share_pct").alias("leader_share_pct"))


def geographic_coverage(fact: DataFrame, dimension: str = "route_description", metric: str = "amount") -> DataFrame:
    """Value, share and clients per route, with a flag for real routes. Blank routes are kept."""
    grand = one_row(fact, F.sum(metric).alias("total"))
    stats = fact.groupBy(clean(dimension).alias("label")).agg(F.sum(metric).alias("exact"), _clients().alias("clients"))
    return stats.select(
        "label", dbl("exact").alias("value"), share_pct("exact", grand.total).alias("share_pct"), "clients",
        (~F.lower("label").isin(*UNCOVERED_ROUTES)).alias("covered"),
    )


def geographic_summary(stats: DataFrame) -> DataFrame:
    exact = F.col("value").cast("decimal(38,6)")
    return stats.agg(
        dbl(F.sum(exact)).alias("total"),
        F.count("*").alias("routes"),
        dbl(F.coalesce(F.sum(F.when(~F.col("covered"), exact)), F.lit(0))).alias("uncovered_value"),
    ).withColumn("uncovered_pct", share_pct("uncovered_value", "total"))


def margin_analysis(fact: DataFrame, dimension: str | None = None, revenue: str = "amount", cost: str = "cost") -> DataFrame:
    """Revenue, cost and margin per label plus a total row, from one grouping-sets aggregation."""
    label = clean(dimension) if dimension else F.lit("Total")
    rows = fact.select(label.alias("label"), F.col(revenue).alias("rev"), F.col(cost).alias("cst"), weight(fact).alias("w"))
    keyed = F.col("label")
    grouped = rows.groupingSets([[keyed], []], keyed).agg(
        F.grouping("label").alias("is_total"),
        F.coalesce(F.sum("rev"), F.lit(0)).alias("rev"),
        F.coalesce(F.sum("cst"), F.lit(0)).alias("cst"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("volume"),
    )
    return grouped.select(
        F.when(F.col("is_total") == 1, "Total").otherwise(F.col("label")).alias("label"),
        (F.col("is_total") == 1).alias("is_total"),
        dbl("rev").alias("revenue"), dbl("cst").alias("cost"),
        dbl(F.col("rev") - F.col("cst")).alias("margin"),
        share_pct(F.col("rev") - F.col("cst"), "rev").alias("margin_pct"),
        "volume",
    )


# --- dispatch -------------------------------------------------------------------------------

ANALYSES = {
    "temporal_trend": lambda fact, dim: temporal_trend_by(fact, dim) if dim else temporal_trend(fact),
    "dimension_ranking": lambda fact, dim: dimension_ranking(fact, dim or "client"),
    "recurrence_churn": lambda fact, dim: churn_risk_list(churn_clients(fact, segment=dim)),
    "cross_sell_mix": lambda fact, dim: cross_sell_mix(fact),
    "seller_performance": lambda fact, dim: seller_performance(fact),
    "geographic_coverage": lambda fact, dim: geographic_coverage(fact),
    "margin_analysis": lambda fact, dim: margin_analysis(fact, dim),
    "sales_force_breakdown": lambda fact, dim: sales_force_breakdown(fact),
    "product_analysis": lambda fact, dim: product_analysis(fact),
    "channel_analysis": lambda fact, dim: channel_analysis(fact),
}


def run_analysis(fact: DataFrame, name: str, dim_a: str | None = None, dim_b: str | None = None) -> DataFrame:
    """One analysis by name, optionally segmented by a dimension or (rankings) a pair."""
    if name not in ANALYSES:
        raise ValueError(f"unknown analysis: {name}")
    if name == "dimension_ranking" and dim_b:
        return dimension_ranking(fact, dim_a, dim_b)
    return ANALYSES[name](fact, dim_a)


# The column an analysis reads for each slot.
SLOT_COLUMNS = {
    "date": "date", "metric": "amount", "client": "client_key", "product": "family", "seller": "seller_name", "route": "route_description",
    "sales_force": "sales_force", "channel": "channel", "revenue": "amount", "cost": "cost",
}


def run_task(fact: DataFrame, name: str, slots: dict[str, str], dim_a: str | None = None, dim_b: str | None = None) -> DataFrame:
    """One analysis on the fields that its slots were resolved to (see profile.slots_of)."""
    columns = {SLOT_COLUMNS[slot]: F.col(f"`{field}`") for slot, field in slots.items()}
    if "date" in slots and "period" not in fact.columns:
        columns["period"] = F.date_format(F.col(f"`{slots['date']}`"), "yyyy-MM")
    return run_analysis(fact.withColumns(columns), name, dim_a, dim_b)


def run_all(fact: DataFrame, names=tuple(ANALYSES), slots: dict[str, dict] | None = None, keep: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Frames of every analysis that the fact's columns allow, and the reason for each that failed.

    With `slots` the analyses run on their resolved fields. With `keep` each is computed and stored here, so that an error while it
    runs is caught as well and the others go on.
    """
    frames, errors = {}, {}
    for name in names:
        try:
            frame = run_task(fact, name, slots[name]) if slots and name in slots else run_analysis(fact, name)
            frames[name] = kept(frame) if keep else frame
        except Exception as error:  # noqa: BLE001 - one analysis must not stop the others
            errors[name] = str(error).splitlines()[0]
    return frames, errors
