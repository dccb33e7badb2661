"""Monthly history, cohorts, concentration and budget comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ventara.functions.numbers import dbl, pct_change_abs, ratio, share_pct, to_tenth
from ventara.functions.text import first_text, label_of
from ventara.operators.core import client_id, invoice_id, money, one_row, ranked, unpivot_dimensions
from ventara.plans.session import checkpoint

# What concentration is measured over, and the mixes shown.
HHI_DIMENSIONS = ("client", "supplier", "seller_name", "channel")
MIX_DIMENSIONS = ("channel", "supplier", "family")


def monthly_history(fact: DataFrame) -> DataFrame:
    """Sales, units, clients and orders per month with rolling averages and changes.

    Averages and the month-over-month change run over the months that exist; the yearly change
    compares with the same month label one year earlier. The windows see one row per month.
    """
    months = fact.groupBy("period").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("exact"),
        money("quantity").alias("quantity"),
        F.count_distinct(client_id()).alias("clients"),
        F.count_distinct(invoice_id()).alias("orders"),
    )
    order = Window.orderBy("period")

    def rolling(n):
        window = order.rowsBetween(-(n - 1), 0)
        return dbl(F.sum("exact").over(window)) / F.count("*").over(window)

    rows = months.select(
        "*", rolling(3).alias("rolling3"), rolling(6).alias("rolling6"), F.lag("exact").over(order).alias("before"),
        F.concat((F.substring("period", 1, 4).cast("int") - 1).cast("string"), F.substring("period", 5, 3)).alias("year_ago"),
    )
    earlier = months.select(F.col("period").alias("year_ago"), F.col("exact").alias("year_ago_sales"))
    return rows.join(earlier, "year_ago", "left").select(
        "period", dbl("exact").alias("sales"), "quantity", "clients", "orders", "rolling3", "rolling6",
        pct_change_abs("exact", F.coalesce("before", F.lit(0))).alias("mom_pct"),
        pct_change_abs("exact", F.coalesce("year_ago_sales", F.lit(0))).alias("yoy_pct"),
    )


def cohorts(fact: DataFrame) -> DataFrame:
    """New, active, recovered, lost and current clients per month.

    Works on distinct (client, month) pairs with a dense month number, so a client contributes at
    most one row per month to its window. The number is the position in the list of months, which
    spares a join. A client's loss counts in the month after its last one.
    """
    months = one_row(fact, F.sort_array(F.collect_set("period")).alias("m")).m
    pairs = fact.select(client_id().alias("client"), "period").filter(F.col("client").isNotNull()).distinct()
    own = Window.partitionBy("client").orderBy("month_no")
    seen = pairs.select("client", F.array_position(months, F.col("period")).alias("month_no")).select(
        "month_no",
        F.lag("month_no").over(own).alias("previous"),
        F.lead("month_no").over(own).alias("next"),
    )
    n = F.col("month_no")
    events = seen.select(F.inline_outer(F.array(
        F.struct(
            n.alias("month_no"), F.when(F.col("previous").isNull(), "new").when(F.col("previous") == n - 1, "active").otherwise("recovered").alias("event")),
        F.struct((n + 1).alias("month_no"), F.when(F.coalesce(F.col("next") != n + 1, F.lit(True)), "lost").alias("event")),
    ))).filter(F.col("event").isNotNull())
    count = lambda e: F.count_if(F.col("event") == e).alias(e)
    counts = events.groupBy("month_no").agg(
        *[count(e) for e in ("new", "active", "recovered", "lost")], F.count_if(F.col("event") != "lost").alias("current_clients"))
    calendar = fact.sparkSession.range(1).select(F.posexplode(months).alias("n", "period")).select((F.col("n") + 1).cast("long").alias("month_no"), "period")
    return calendar.join(counts, "month_no", "left").na.fill(0).select("period", "new", "active", "recovered", "lost", "current_clients")


def client_sales(rows: DataFrame) -> DataFrame:
    name = F.coalesce(first_text("client", "client_name", "client_key"), F.lit("Sin cliente"))
    return rows.groupBy(name.alias("client")).agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("exact"))


def running_totals(df: DataFrame, order, value: str) -> DataFrame:
    """Rank and running sum over a whole sorted frame without gathering it in one task.

    The sort range-partitions the rows; its result is stored once, so that the partition numbers
    stay fixed. Each partition is then ranked on its own and shifted by the rows and the sum of
    the partitions before it (one small row per partition).
    """
    stored = checkpoint(df.orderBy(*order).withColumn("part", F.spark_partition_id()))
    sizes = stored.groupBy("part").agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("sum_before"))
    inside = Window.partitionBy("part").orderBy(*order)
    return stored.join(offsets, "part").select(
        *df.columns,
        (F.row_number().over(inside) + F.col("rows_before")).alias("rank"),
        (F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("sum_before")).alias("running"),
    )


def pareto(rows: DataFrame) -> DataFrame:
    """All clients by sales with share and cumulative share (at most 100)."""
    total = one_row(rows, F.coalesce(F.sum("amount"), F.lit(0)).alias("t")).t
    listed = running_totals(client_sales(rows), [F.desc("exact"), "client"], "exact")
    return listed.select(
        F.col("rank").cast("long").alias("rank"), "client", dbl("exact").alias("sales"), share_pct("exact", total).alias("share_pct"),
        F.least(share_pct("running", total), F.lit(100.0)).alias("cumulative_pct"),
    )


def pareto_top(rows: DataFrame, n: int = 20) -> DataFrame:
    """The n largest clients with share and cumulative share."""
    total = one_row(rows, F.coalesce(F.sum("amount"), F.lit(0)).alias("t")).t
    top = ranked(client_sales(rows), n, [F.desc("exact"), "client"])
    running = F.sum("exact").over(Window.orderBy("rank"))  # n rows
    return top.withColumn("running", running).select(
        F.col("rank").cast("long").alias("rank"), "client", dbl("exact").alias("sales"), share_pct("exact", total).alias("share_pct"),
        F.least(share_pct("running", total), F.lit(100.0)).alias("cumulative_pct"),
    )


def _dimension_sales(rows: DataFrame, dimensions) -> DataFrame:
    return unpivot_dimensions(rows, dimensions, ["amount"]).groupBy("dimension", "label").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("exact"))


def hhi(rows: DataFrame, dimensions=HHI_DIMENSIONS) -> DataFrame:
    """Herfindahl index per dimension, from unrounded shares."""
    total = one_row(rows, F.coalesce(F.sum("amount"), F.lit(0)).alias("t")).t
    share = ratio("exact", total)
    return _dimension_sales(rows, dimensions).groupBy("dimension").agg((F.sum(share * share) * 10000).alias("hhi"))


def dimension_mix(rows: DataFrame, dimensions=MIX_DIMENSIONS, n: int = 4) -> DataFrame:
    """Sales and share of the largest labels per dimension."""
    total = one_row(rows, F.coalesce(F.sum("amount"), F.lit(0)).alias("t")).t
    top = ranked(_dimension_sales(rows, dimensions), n, [F.desc("exact"), "label"], by=["dimension"])
    return top.select("dimension", "rank", "label", dbl("exact").alias("sales"), share_pct("exact", total).alias("share_pct"))


def history_summary(fact: DataFrame, rows: DataFrame) -> DataFrame:
    """Last month with its changes and averages, and the concentration of the selected rows."""
    last = monthly_history(fact).agg(F.count("*").alias("months"), F.max(F.struct(
        "period", "sales", "quantity", "rolling3", "rolling6", "mom_pct", "yoy_pct")).alias("m"))
    total = one_row(rows, F.coalesce(F.sum("amount"), F.lit(0)).alias("t")).t
    clients = ranked(client_sales(rows), 10, [F.desc("exact"), "client"])
    suppliers = ranked(_dimension_sales(rows, ["supplier"]), 5, [F.desc("exact"), "label"])
    return last.select(
        "months", F.col("m.period").alias("last_period"), F.col("m.sales").alias("sales"), F.col("m.quantity").alias("quantity"),
        F.col("m.mom_pct").alias("mom_pct"), F.col("m.yoy_pct").alias("yoy_pct"), F.col("m.rolling3").alias("rolling3"), F.col("m.rolling6").alias("rolling6"),
        one_row(hhi(rows, ["client"]), F.max("hhi").alias("h")).h.alias("hhi_client"),
        share_pct(one_row(clients, F.sum("exact").alias("s")).s, total).alias("top10_clients_pct"),
        share_pct(one_row(suppliers, F.sum("exact").alias("s")).s, total).alias("top5_suppliers_pct"),
    )


def history_alerts(summary: DataFrame) -> DataFrame:
    rules = [
        ("caída mensual", to_tenth("mom_pct") <= -8, "mom_pct"),
        ("dependencia de clientes", to_tenth("top10_clients_pct") >= 45, "top10_clients_pct"),
        ("concentración", F.round("hhi_client", 0) >= 900, "hhi_client"),
    ]
    structs = F.array(*[F.when(fires, F.struct(F.lit("history").alias("board"), F.lit("warn").alias("severity"), F.lit(t).alias("topic"), F.col(v).alias("value"))) for t, fires, v in rules])
    return summary.select(F.inline_outer(F.filter(structs, lambda x: x.isNotNull()))).filter(F.col("topic").isNotNull())


# --- budget ---------------------------------------------------------------------------------

# Budget dimensions and their fact fields.
BUDGET_FIELDS = {"channel": "channel", "seller": "seller_name", "family": "family"}


def budget_monthly(fact: DataFrame, budget: DataFrame) -> DataFrame:
    """Actual sales per month against the monthly budget (period, budget); no plan counts as zero."""
    plan = budget.groupBy("period").agg(F.max("budget").cast("decimal(38,6)").alias("budget"))
    months = fact.groupBy("period").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("actual"))
    return months.join(plan, "period", "left").select(
        "period", dbl("actual").alias("sales"), dbl(F.coalesce("budget", F.lit(0))).alias("budget"),
        dbl(F.col("actual") - F.coalesce("budget", F.lit(0))).alias("gap"), pct_change_abs("actual", F.coalesce("budget", F.lit(0))).alias("gap_pct"),
    )


def budget_summary(monthly: DataFrame) -> DataFrame:
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,6)"))
    row = monthly.agg(
        F.count_if(F.col("budget") > 0).alias("months_budgeted"),
        F.max(F.struct("period", "budget", "gap", "gap_pct")).alias("m"),
        exact("sales").alias("actual"), exact("budget").alias("plan"),
    )
    return row.select(
        "months_budgeted", F.col("m.period").alias("last_period"), F.col("m.budget").alias("last_budget"), F.col("m.gap").alias("last_gap"),
        F.col("m.gap_pct").alias("last_gap_pct"), dbl("plan").alias("total_budget"), dbl(F.col("actual") - F.col("plan")).alias("total_gap"),
        pct_change_abs("actual", "plan").alias("total_gap_pct"),
    )


def budget_alerts(summary: DataFrame) -> DataFrame:
    planned = F.col("months_budgeted") > 0
    rules = [
        ("último mes bajo plan", planned & (to_tenth("last_gap_pct") <= -6), "last_gap_pct"),
        ("acumulado bajo plan", planned & (F.col("total_gap") < 0), "total_gap"),
    ]
    structs = F.array(*[F.when(fires, F.struct(F.lit("budget").alias("board"), F.lit("warn").alias("severity"), F.lit(t).alias("topic"), F.col(v).alias("value"))) for t, fires, v in rules])
    return summary.select(F.inline_outer(F.filter(structs, lambda x: x.isNotNull()))).filter(F.col("topic").isNotNull())


def budget_by_dimension(fact: DataFrame, budget: DataFrame, shares: DataFrame, dimension: str = "total", n: int = 12) -> DataFrame:
    """Last month's sales per label against its budget share; the n largest labels plus the budgeted ones.

    `shares` has (label, share_pct). With dimension 'total' the whole month is one row.
    """
    last = one_row(fact, F.max("period").alias("p")).p
    rows = fact.filter(F.col("period") == last)
    plan = budget.filter(F.col("period") == last)
    month_budget = F.coalesce(one_row(plan, F.max("budget").cast("decimal(38,6)").alias("b")).b, F.lit(0))
    total = one_row(rows, F.sum("amount").alias("t")).t
    if dimension == "total":
        return rows.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("actual")).select(
            F.lit("Total").alias("label"), dbl("actual").alias("sales"), F.when(F.col("actual") != 0, 100.0).otherwise(0.0).alias("share_pct"),
            F.when(month_budget != 0, 100.0).otherwise(0.0).alias("budget_share_pct"), dbl(month_budget).alias("budget"),
            (dbl("actual") - dbl(month_budget)).alias("gap"), pct_change_abs("actual", month_budget).alias("gap_pct"),
        )
    field = BUDGET_FIELDS[dimension]
    actual = rows.groupBy(label_of(field).alias("label")).agg(F.sum("amount").alias("actual"))
    top = ranked(actual, n, [F.desc("actual"), "label"]).select("label", F.lit(True).alias("listed"))
    # A label the plan knows is shown even when it is small or has no sales.
    joined = actual.join(top, "label", "left").join(shares.select("label", F.col("share_pct").alias("plan_pct")), "label", "full_outer")
    kept = joined.filter(F.col("listed") | F.col("plan_pct").isNotNull()).select(
        "label", F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce(dbl("plan_pct"), F.lit(0.0)).alias("budget_share_pct"))
    planned = (dbl(month_budget) * F.col("budget_share_pct") / 100).alias("budget")
    return kept.select("label", dbl("actual").alias("sales"), share_pct("actual", total).alias("share_pct"), "budget_share_pct", planned).select(
        "*", (F.col("sales") - F.col("budget")).alias("gap"), pct_change_abs("sales", "budget").alias("gap_pct"))
