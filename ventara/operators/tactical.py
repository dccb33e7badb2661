"""Month-to-date dashboard: pace, objective, movement, dimensions and planning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ventara.functions.numbers import dbl, pct_change_abs, ratio, share_pct, to_tenth
from ventara.functions.rows import literal_rows
from ventara.functions.text import first_text, label_of
from ventara.operators.core import amount_where, client_id, invoice_id, one_row, ranked, unpivot_dimensions, usual_values, weight
from ventara.plans.period import MonthWindow, between, day, month_end, shift_month

# Dimensions of the month dashboard.
DIMENSIONS = ("seller_name", "route_description", "channel", "supplier", "family")

# Pace scenarios in percent.
SCENARIOS = (("Conservador", -12.0), ("Ajuste leve", -5.0), ("Ritmo actual", 0.0), ("Recuperación", 8.0), ("Aceleración", 15.0))

# Dimension a plan can focus on.
FOCUS_DIMENSIONS = {"channel": "channel", "seller": "seller_name", "family": "family"}


def _exact(c):
    return F.col(c).cast("decimal(38,6)")


def in_current(m: MonthWindow) -> Column:
    return between("date", m.start, m.as_of)


def in_previous(m: MonthWindow) -> Column:
    return between("date", m.previous_start, m.previous_end)


def in_previous_full(m: MonthWindow) -> Column:
    return between("date", m.previous_start, m.previous_full_end)


def in_year_ago(m: MonthWindow) -> Column:
    return between("date", m.year_ago_start, m.year_ago_end)


# --- totals, objective, pace ----------------------------------------------------------------


def month_totals(fact: DataFrame, m: MonthWindow) -> DataFrame:
    """Sales and units of the month to date, of the same days last month and last year, and their changes."""
    windows = {"": in_current(m), "previous_": in_previous(m), "year_ago_": in_year_ago(m)}
    rows = fact.filter(windows[""] | windows["previous_"] | windows["year_ago_"])
    row = rows.agg(*[
        dbl(amount_where(w, measure)).alias(f"{name}{out}")
        for name, w in windows.items() for measure, out in (("amount", "sales"), ("quantity", "units"))
    ])
    change = lambda a, b, n: pct_change_abs(a, b).alias(n)
    return row.select(
        "*", change("sales", "previous_sales", "sales_vs_previous_pct"), change("units", "previous_units", "units_vs_previous_pct"),
        change("sales", "year_ago_sales", "sales_vs_year_ago_pct"), change("units", "year_ago_units", "units_vs_year_ago_pct"),
    )


def objective_drivers(fact: DataFrame, m: MonthWindow) -> DataFrame:
    """Benchmarks of the objective that have rows: last month, same month last year, mean of three months."""
    starts = [shift_month(m.start, -i) for i in (1, 2, 3)]
    year_ago = shift_month(m.start, -12)
    windows = [between("date", s, month_end(s)) for s in [*starts, year_ago]]
    rows = fact.filter(reduce(lambda a, b: a | b, windows))
    names = ("m1", "m2", "m3", "y")
    row = rows.agg(*[
        a for n, w in zip(names, windows)
        for a in (F.count_if(w).alias(f"{n}_rows"), amount_where(w).alias(f"{n}_sales"), amount_where(w, "quantity").alias(f"{n}_units"))
    ])
    months = [F.when(F.col(f"{n}_rows") > 0, 1).otherwise(0) for n in names[:3]]
    count = reduce(lambda a, b: a + b, months)
    mean = lambda f: dbl(reduce(lambda a, b: a + b, [F.col(f"{n}_{f}") for n in names[:3]])) / F.nullif(dbl(count), F.lit(0.0))
    drivers = F.array(
        F.when(F.col("m1_rows") > 0, F.struct(F.lit("Mes anterior completo").alias("driver"), dbl("m1_sales").alias("sales"), dbl("m1_units").alias("units"))),
        F.when(F.col("y_rows") > 0, F.struct(F.lit("Mismo mes año anterior").alias("driver"), dbl("y_sales").alias("sales"), dbl("y_units").alias("units"))),
        F.when(count > 0, F.struct(F.lit("Promedio móvil 3M").alias("driver"), mean("sales").alias("sales"), mean("units").alias("units"))),
    )
    return row.select(F.inline_outer(F.filter(drivers, lambda d: d.isNotNull()))).filter(F.col("driver").isNotNull())


def objective(fact: DataFrame, m: MonthWindow) -> DataFrame:
    """Objective of the month: median of the benchmarks, zero without any."""
    return objective_drivers(fact, m).agg(
        F.coalesce(F.median("sales"), F.lit(0.0)).alias("objective_sales"), F.coalesce(F.median("units"), F.lit(0.0)).alias("objective_units"))


def pace(fact: DataFrame, m: MonthWindow) -> DataFrame:
    """Objective to date and projection to the month end."""
    goal = one_row(objective(fact, m), F.max(F.struct("*")).alias("g")).g
    elapsed, days = float(max(m.elapsed, 1)), float(m.days)
    rows = month_totals(fact, m).withColumn("g", goal)
    return rows.select(
        *[c for c in rows.columns if c != "g"],
        F.col("g.objective_sales").alias("objective_sales_close"), F.col("g.objective_units").alias("objective_units_close"),
        (F.col("g.objective_sales") * (elapsed / days)).alias("objective_sales"), (F.col("g.objective_units") * (elapsed / days)).alias("objective_units"),
        (F.col("sales") / elapsed * days).alias("projected_sales"), (F.col("units") / elapsed * days).alias("projected_units"),
    )


def sensitivity(fact: DataFrame, m: MonthWindow) -> DataFrame:
    """Close of the month under five paces, with the pace that is needed."""
    elapsed, left = float(max(m.elapsed, 1)), float(m.remaining)
    row = pace(fact, m).select(
        "sales", "units", "objective_sales_close", "objective_units_close",
        (F.col("sales") / elapsed).alias("sales_per_day"), (F.col("units") / elapsed).alias("units_per_day"),
        (F.greatest(F.col("objective_sales_close") - F.col("sales"), F.lit(0.0)) / max(left, 1.0)).alias("required_sales_per_day"),
        (F.greatest(F.col("objective_units_close") - F.col("units"), F.lit(0.0)) / max(left, 1.0)).alias("required_units_per_day"),
    )
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(p).alias("pace_pct")) for n, p in SCENARIOS])
    factor = 1 + F.col("pace_pct") / 100
    rows = row.select("*", F.inline_outer(scenarios)).select(
        "scenario", "pace_pct", (F.col("sales") + F.col("sales_per_day") * factor * left).alias("projected_sales"),
        (F.col("units") + F.col("units_per_day") * factor * left).alias("projected_units"),
        (F.col("sales_per_day") * factor).alias("sales_per_day"), (F.col("units_per_day") * factor).alias("units_per_day"),
        "required_sales_per_day", "required_units_per_day", "objective_sales_close",
    )
    gap = pct_change_abs("projected_sales", "objective_sales_close")
    tone = F.when(to_tenth("gap_pct") >= 2, "good").when(to_tenth("gap_pct") >= -3, "warn").otherwise("bad")
    return rows.withColumn("gap_pct", gap).withColumn("tone", tone).drop("objective_sales_close")


# --- clients --------------------------------------------------------------------------------


def _client_flags(fact: DataFrame, m: MonthWindow) -> DataFrame:
    """Which windows each client bought in: one aggregation instead of set operations."""
    rows = fact.filter(F.col("date") <= day(max(m.as_of, m.previous_full_end))).select(client_id().alias("client"), "date")
    return rows.filter(F.col("client").isNotNull()).groupBy("client").agg(
        F.bool_or(in_current(m)).alias("cur"), F.bool_or(in_previous(m)).alias("prev"), F.bool_or(in_previous_full(m)).alias("prev_full"),
        F.bool_or(F.col("date") < day(m.start)).alias("history"),
    )


def client_movement(fact: DataFrame, m: MonthWindow) -> DataFrame:
    """Clients active, without purchase, dropped, recovered and new in the month."""
    cur, prev, full, past = (F.col(c) for c in ("cur", "prev", "prev_full", "history"))
    return _client_flags(fact, m).agg(
        F.count_if(cur).alias("active"), F.count_if(prev).alias("previous_active"),
        F.count_if(full & ~cur).alias("without_purchase"), F.count_if(prev & ~cur).alias("dropped"),
        F.count_if(cur & past & ~full).alias("recovered"), F.count_if(cur & ~past).alias("new"),
    )


def month_clients(fact: DataFrame, m: MonthWindow) -> DataFrame:
    """Clients of the month with orders, breadth, usual owner, change and lifecycle."""
    cur, prev = in_current(m), in_previous(m)
    family = F.when(~F.lower(label_of("family")).startswith("sin "), F.col("family"))
    rows = fact.filter(F.col("date") <= day(m.as_of)).select(
        client_id().alias("client_id"), "date", invoice_id().alias("invoice"), "amount", "quantity", family.alias("family"),
        cur.alias("cur"), prev.alias("prev"), in_previous_full(m).alias("full"), (F.col("date") < day(m.start)).alias("past"),
    )
    c = F.col("cur")
    stats = rows.filter(F.col("client_id").isNotNull()).groupBy("client_id").agg(
        F.max(F.when(c, F.col("date"))).alias("last_date"),
        amount_where(c).alias("sales"), amount_where(c, "quantity").alias("quantity"), amount_where(F.col("prev")).alias("previous_sales"),
        amount_where(F.col("past")).alias("history_sales"),
        F.count_distinct(F.when(c, F.col("invoice"))).alias("orders"), F.count_distinct(F.when(c, F.col("family"))).alias("families"),
        F.bool_or("cur").alias("buys"), F.bool_or("full").alias("bought_full"), F.bool_or("past").alias("bought_before"),
    ).filter("buys")
    owner = {"seller": "seller_name", "route": "route_description", "force": "sales_force"}
    name = first_text("client", "client_name", "client_key").alias("client")
    combos = fact.filter(cur & client_id().isNotNull()).select(client_id().alias("client_id"), name, "date", *[label_of(f).alias(n) for n, f in owner.items()], weight(fact).alias("w"))
    combos = combos.groupBy("client_id", "client", *owner).agg(F.sum("w").alias("n"), F.max("date").alias("date"))
    names = combos.groupBy("client_id").agg(F.max(F.struct("date", "client")).alias("last"))
    stats = stats.join(names, "client_id").join(usual_values(combos, "client_id", owner), "client_id")
    total = one_row(fact.filter(cur), F.coalesce(F.sum("amount"), F.lit(0)).alias("t")).t
    status = F.when(~F.col("bought_before"), "Nuevo").when(~F.col("bought_full"), "Recuperado").otherwise("Activo")
    return stats.select(
        "client_id", F.col("last.client").alias("client"), dbl("sales").alias("sales"), dbl("quantity").alias("quantity"), "orders",
        ratio("sales", "orders").alias("avg_ticket"), ratio("quantity", "orders").alias("avg_units_per_order"), "families",
        "last_date", "seller", "route", F.col("force").alias("sales_force"),
        dbl("previous_sales").alias("previous_sales"), pct_change_abs("sales", "previous_sales").alias("sales_delta_pct"),
        share_pct("sales", total).alias("share_pct"), status.alias("status"), dbl("history_sales").alias("history_sales"),
    )


def month_client_table(clients: DataFrame, n: int = 50) -> DataFrame:
    return ranked(clients, n, [F.desc("sales"), "client_id"])


def executive_table(clients: DataFrame, n: int = 50) -> DataFrame:
    """Rank and the columns management looks at."""
    return month_client_table(clients, n).select(
        "rank", "client", "status", "sales", F.col("quantity").alias("units"), "avg_ticket", "avg_units_per_order", "families", "last_date",
        "sales_force", "route", "seller", "share_pct", "sales_delta_pct",
    )


def executive_fallback(clients: DataFrame, mode: str = "sales", n: int = 10) -> DataFrame:
    """The table where there are no figures of a month: the largest clients of the period, by sales or by units."""
    metric = "quantity" if mode == "units" else "sales"
    top = ranked(clients, n, [F.desc(metric), "client_key"])
    return top.select(
        "rank", "client", F.coalesce("status", F.lit("Activo")).alias("status"), dbl("sales").alias("sales"), dbl("quantity").alias("units"), "avg_ticket", "avg_units_per_order", "families", "last_date",
        "sales_force", F.col("route_description").alias("route"), F.col("seller_name").alias("seller"),
        F.lit(None).cast("double").alias("share_pct"), F.lit(None).cast("double").alias("sales_delta_pct"),
    )


def lost_key_accounts(fact: DataFrame, m: MonthWindow, n: int = 50) -> DataFrame:
    """Largest clients of last month that have not bought this month."""
    buyers = fact.filter(in_previous_full(m)).select(client_id().alias("client_id"), "amount").filter(F.col("client_id").isNotNull())
    top = ranked(buyers.groupBy("client_id").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("exact")), n, [F.desc("exact"), "client_id"])
    current = fact.filter(in_current(m)).select(client_id().alias("client_id")).distinct()
    return top.join(current, "client_id", "left_anti").select("rank", "client_id", dbl("exact").alias("sales"))


# --- dimensions and curves ------------------------------------------------------------------


def dimensions_vs_previous(fact: DataFrame, m: MonthWindow, dimensions=DIMENSIONS) -> DataFrame:
    """Labels of every dimension with this month against the same days last month."""
    cur, prev = F.col("cur"), F.col("prev")
    rows = fact.withColumns({"cur": in_current(m), "prev": in_previous(m), "buyer": client_id(), "order": invoice_id()}).filter(cur | prev)
    long = unpivot_dimensions(rows, dimensions, ["cur", "prev", "buyer", "order", "amount", "quantity"])
    stats = long.groupBy("dimension", "label").agg(
        amount_where(cur).alias("sales"), amount_where(prev).alias("previous_sales"), amount_where(cur, "quantity").alias("quantity"),
        F.count_distinct(F.when(cur, F.col("buyer"))).alias("clients"), F.count_distinct(F.when(prev, F.col("buyer"))).alias("previous_clients"),
        F.count_distinct(F.when(cur, F.col("order"))).alias("orders"),
    )
    total = one_row(fact.filter(in_current(m)), F.coalesce(F.sum("amount"), F.lit(0)).alias("t")).t
    return stats.select(
        "dimension", "label", dbl("sales").alias("sales"), dbl("previous_sales").alias("previous_sales"), dbl("quantity").alias("quantity"),
        "clients", "previous_clients", "orders", pct_change_abs("sales", "previous_sales").alias("growth_pct"),
        (F.col("clients") - F.col("previous_clients")).alias("client_delta"), share_pct("sales", total).alias("share_pct"),
    )


def daily_curves(fact: DataFrame, m: MonthWindow) -> DataFrame:
    """Running sales per day of the month for this month, last month and last year, with the linear objective."""
    windows = {"current": (m.start, m.as_of), "previous": (m.previous_start, m.previous_end), "year_ago": (m.year_ago_start, m.year_ago_end)}
    inside = reduce(lambda a, b: a | b, [between("date", a, b) for a, b in windows.values()])
    daily = fact.filter(inside).groupBy("date").agg(F.sum("amount").alias("amount"))
    series = F.when(between("date", *windows["current"]), "current").when(between("date", *windows["previous"]), "previous").otherwise("year_ago")
    known = daily.select(series.alias("series"), F.dayofmonth("date").alias("day"), "amount")
    calendar = literal_rows(fact.sparkSession, ["series", "day"], [(s, d) for s, (a, b) in windows.items() for d in range(a.day, b.day + 1)])
    running = Window.partitionBy("series").orderBy("day")  # at most 31 rows
    curves = calendar.join(known, ["series", "day"], "left").select(
        "series", "day", dbl(F.coalesce(F.sum("amount").over(running), F.lit(0))).alias("value"))
    goal = one_row(objective(fact, m), F.max("objective_sales").alias("o")).o
    line = literal_rows(fact.sparkSession, ["series", "day"], [("objective", d) for d in range(1, m.elapsed + 1)]).select(
        "series", "day", (goal * F.col("day") / float(m.days)).alias("value"))
    return curves.unionByName(line)


# --- summary and alerts ---------------------------------------------------------------------


def month_summary(fact: DataFrame, m: MonthWindow) -> DataFrame:
    """The figures of the month in one row."""
    elapsed, left = float(max(m.elapsed, 1)), float(m.remaining)
    move = one_row(client_movement(fact, m), F.max(F.struct("*")).alias("c")).c
    orders = one_row(fact.filter(in_current(m)), F.count_distinct(invoice_id()).alias("n")).n
    row = pace(fact, m).withColumn("c", move).withColumn("orders", orders)
    required = lambda o, v: F.greatest(F.col(o) - F.col(v), F.lit(0.0)) / max(left, 1.0)
    return row.select(
        "sales", "units", "objective_sales", "objective_units", "objective_sales_close", "objective_units_close", "projected_sales", "projected_units",
        pct_change_abs("sales", "objective_sales").alias("sales_vs_objective_pct"), pct_change_abs("units", "objective_units").alias("units_vs_objective_pct"),
        "sales_vs_previous_pct", "sales_vs_year_ago_pct", "units_vs_previous_pct", "units_vs_year_ago_pct",
        F.col("c.active").alias("active_clients"), F.col("c.without_purchase").alias("without_purchase"), F.col("c.dropped").alias("dropped"),
        F.col("c.recovered").alias("recovered"), F.col("c.new").alias("new_clients"),
        ratio("sales", "c.active").alias("ticket_per_client"), ratio("units", "c.active").alias("units_per_client"), "orders",
        ratio("orders", "c.active").alias("frequency"), pct_change_abs("projected_sales", "objective_sales_close").alias("projected_gap_pct"),
        (F.col("sales") / elapsed).alias("sales_per_day"), (F.col("units") / elapsed).alias("units_per_day"),
        required("objective_sales_close", "sales").alias("required_sales_per_day"), required("objective_units_close", "units").alias("required_units_per_day"),
        F.lit(m.remaining).cast("long").alias("remaining_days"),
    )


def month_kpis(summary: DataFrame) -> DataFrame:
    """Ten indicators with their tone."""
    ahead = lambda a, b, other: F.when(F.col(a) >= F.col(b), "good").otherwise(other)
    up = lambda c: F.when(F.col(c) >= 0, "good").otherwise("warn")
    recovering = F.when(F.col("recovered") >= F.greatest(F.col("dropped"), F.lit(1)) * 0.35, "good").otherwise("warn")
    cards = [
        ("Venta acumulada", "sales", ahead("sales", "objective_sales", "bad")), ("Proyección cierre", "projected_sales", ahead("projected_sales", "objective_sales_close", "warn")),
        ("Vs objetivo", "sales_vs_objective_pct", ahead("sales", "objective_sales", "bad")), ("Vs mes anterior", "sales_vs_previous_pct", up("sales_vs_previous_pct")),
        ("Vs año anterior", "sales_vs_year_ago_pct", up("sales_vs_year_ago_pct")), ("Clientes activos", "active_clients", F.lit("neutral")),
        ("Clientes recuperados", "recovered", recovering), ("Ticket por cliente", "ticket_per_client", F.lit("neutral")),
        ("Bultos por cliente", "units_per_client", F.lit("neutral")), ("Bultos vs objetivo", "units_vs_objective_pct", ahead("units", "objective_units", "warn")),
    ]
    structs = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(n).alias("label"), dbl(v).alias("value"), t.alias("tone")) for i, (n, v, t) in enumerate(cards, 1)])
    return summary.select(F.inline_outer(structs))


def _worst(dimensions: DataFrame, name: str, condition: Column, by: str = "growth_pct") -> Column:
    rows = dimensions.filter((F.col("dimension") == name) & condition)
    return one_row(rows, F.min(F.struct(F.col(by).cast("double").alias("value"), F.col("label"))).alias("w")).w


def _alerts(row: DataFrame, rules, extra=()) -> DataFrame:
    structs = F.array(*[
        F.when(fires, F.struct(
            F.lit(i).cast("long").alias("rule"), *[F.lit(t).alias(n) for n, t in zip(extra, texts[1:])], F.lit(texts[0]).alias("topic"),
            severity.alias("severity"), dbl(value).alias("value"), label.alias("label")))
        for i, (texts, severity, fires, value, label) in enumerate(rules, 1)
    ])
    return row.select(F.inline_outer(F.filter(structs, lambda x: x.isNotNull()))).filter(F.col("rule").isNotNull())


def month_alerts(fact: DataFrame, m: MonthWindow, dimensions: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """Alerts of the month that fire, in rule order."""
    dims = dimensions if dimensions is not None else dimensions_vs_previous(fact, m)
    growth, current = to_tenth("growth_pct"), one_row(fact.filter(in_current(m)), F.coalesce(F.sum("amount"), F.lit(0)).alias("s")).s
    large = F.greatest(_exact("sales"), _exact("previous_sales")) >= current * 0.015
    lost = one_row(lost_key_accounts(fact, m), F.count("*").alias("n")).n
    row = month_summary(fact, m).select("sales", "objective_sales", "sales_vs_objective_pct", "dropped").withColumns({
        "seller": _worst(dims, "seller_name", (growth <= -12) & large),
        "route": _worst(dims, "route_description", F.col("client_delta") <= -8, "client_delta"),
        "supplier": _worst(dims, "supplier", (growth <= -10) & (F.col("sales") > 0)),
        "family": _worst(dims, "family", (growth <= -10) & (to_tenth("share_pct") >= 5)),
        "lost": lost,
    })
    none, warn = F.lit(None).cast("string"), F.lit("warn")
    gap = F.abs(to_tenth("sales_vs_objective_pct"))
    rules = [
        (("ritmo",), F.when(gap >= 5, "critical").otherwise("warn"), F.col("sales") < F.col("objective_sales") * 0.99, "sales_vs_objective_pct", none),
        (("clientes caídos",), warn, F.col("dropped") >= 15, "dropped", none),
        *[((t,), warn, F.col(c).isNotNull(), f"{c}.value", F.col(f"{c}.label")) for t, c in (
            ("vendedor", "seller"), ("ruta", "route"), ("proveedor", "supplier"), ("familia", "family"))],
        (("cuentas clave",), F.lit("critical"), F.col("lost") > 0, "lost", none),
    ]
    return _alerts(row, rules).orderBy("rule").limit(limit)


def role_alerts(fact: DataFrame, m: MonthWindow, dimensions: DataFrame | None = None, limit: int = 6) -> DataFrame:
    """Alerts addressed to a role: close, sellers, routes, channels, families and key accounts."""
    dims = dimensions if dimensions is not None else dimensions_vs_previous(fact, m)
    growth, current = to_tenth("growth_pct"), one_row(fact.filter(in_current(m)), F.coalesce(F.sum("amount"), F.lit(0)).alias("s")).s
    large = F.greatest(_exact("sales"), _exact("previous_sales")) >= current * 0.015
    row = month_summary(fact, m).select("sales_vs_objective_pct", "projected_gap_pct").withColumns({
        "seller": _worst(dims, "seller_name", (growth <= -10) & large),
        "route": _worst(dims, "route_description", F.col("client_delta") <= -6, "client_delta"),
        "channel": _worst(dims, "channel", (growth <= -8) & (F.col("clients") >= 20)),
        "family": _worst(dims, "family", (growth <= -8) & (to_tenth("share_pct") >= 5)),
        "lost": one_row(lost_key_accounts(fact, m), F.count("*").alias("n")).n,
    })
    projected = to_tenth("projected_gap_pct")
    risky = (to_tenth("sales_vs_objective_pct") < -4) | (projected < -3)
    none, warn = F.lit(None).cast("string"), F.lit("warn")
    rules = [
        (("Riesgo de cierre", "Dirección"), F.when(projected < -8, "critical").otherwise("warn"), risky, "projected_gap_pct", none),
        (("Cierre controlado", "Dirección"), F.lit("good"), ~risky, "projected_gap_pct", none),
        (("Vendedor a corregir", "Jefatura ventas"), warn, F.col("seller").isNotNull(), "seller.value", F.col("seller.label")),
        (("Ruta debilitada", "Supervisión"), warn, F.col("route").isNotNull(), "route.value", F.col("route.label")),
        (("Canal con baja rotación", "Canales"), warn, F.col("channel").isNotNull(), "channel.value", F.col("channel.label")),
        (("Familia en retracción", "Trade / Compras"), warn, F.col("family").isNotNull(), "family.value", F.col("family.label")),
        (("Clientes relevantes sin compra", "Key accounts"), F.when(F.col("lost") >= 20, "critical").otherwise("warn"), F.col("lost") > 0, "lost", none),
    ]
    return _alerts(row, rules, ("role",)).orderBy("rule").limit(limit)


# --- planning -------------------------------------------------------------------------------


def planning_rows(dimensions: DataFrame, targets: DataFrame, m: MonthWindow, focus: str = "channel", n: int = 8) -> DataFrame:
    """Largest labels of the focus dimension with their projection and planned uplift.

    `targets` has (label, uplift_pct); labels without a target keep their projection.
    """
    days, elapsed = float(max(m.days, 1)), float(max(m.elapsed, 1))
    rows = dimensions.filter(F.col("dimension") == FOCUS_DIMENSIONS[focus])
    top = ranked(rows, n, [F.desc("sales"), "label"])
    goals = targets.groupBy("label").agg(F.round(F.max("uplift_pct"), 1).alias("uplift_pct"))
    base = F.col("sales") / elapsed * days
    return top.join(goals, "label", "left").select(
        "rank", "label", "share_pct", "sales", "clients", "growth_pct", F.coalesce("uplift_pct", F.lit(0.0)).alias("uplift_pct"),
        base.alias("base_projection"),
    ).select(
        "*", (F.col("base_projection") * (1 + F.col("uplift_pct") / 100)).alias("target_projection"),
        (F.col("base_projection") * (1 + F.col("uplift_pct") / 100) - F.col("base_projection")).alias("incremental_sales"),
    )


def planning_summary(fact: DataFrame, rows: DataFrame, m: MonthWindow, global_target_pct: float = 0.0, recovery_goal: int = 0) -> DataFrame:
    """Adjusted objective, simulated close and the recoveries still missing."""
    cents = F.round(F.greatest(F.col("incremental_sales"), F.lit(0.0)), 2).cast("decimal(28,2)")
    extra = one_row(rows, dbl(F.coalesce(F.sum(cents), F.lit(0))).alias("e")).e
    row = month_summary(fact, m).select(
        (F.col("objective_sales_close") * (1 + round(global_target_pct, 1) / 100)).alias("adjusted_objective"),
        F.col("projected_sales").alias("base_projection"), extra.alias("additional_sales"),
        F.greatest(F.lit(max(int(recovery_goal), 0)) - F.col("recovered"), F.lit(0)).cast("long").alias("recovery_gap"),
    )
    return row.withColumn("simulated_close", F.col("base_projection") + F.col("additional_sales")).select(
        "*", pct_change_abs("simulated_close", "adjusted_objective").alias("gap_pct"), share_pct("additional_sales", "base_projection").alias("weighted_uplift_pct"))


def planning_alerts(summary: DataFrame) -> DataFrame:
    goal, close = F.col("adjusted_objective"), F.col("simulated_close")
    rules = [
        (("simulación bajo meta",), F.when(close >= goal * 0.94, "warn").otherwise("critical"), (goal > 0) & (close < goal * 0.98), "gap_pct", F.lit(None).cast("string")),
        (("recuperación pendiente",), F.lit("warn"), F.col("recovery_gap") > 0, "recovery_gap", F.lit(None).cast("string")),
    ]
    return _alerts(summary, rules)


def owner_tracking(dimensions: DataFrame, targets: DataFrame, m: MonthWindow, n: int = 16) -> DataFrame:
    """Largest sellers with their projection against their own target. `targets` has (seller, target_pct)."""
    days, elapsed = float(max(m.days, 1)), float(max(m.elapsed, 1))
    top = ranked(dimensions.filter(F.col("dimension") == "seller_name"), n, [F.desc("sales"), "label"])
    goals = targets.groupBy(F.col("seller").alias("label")).agg(F.round(F.max("target_pct"), 1).alias("target_pct"))
    rows = top.join(goals, "label", "left").select(
        "rank", F.col("label").alias("seller"), "sales", "clients", "growth_pct", "share_pct", F.coalesce("target_pct", F.lit(0.0)).alias("target_pct"),
        (F.col("sales") / elapsed * days).alias("projection"),
    ).withColumn("target", F.col("projection") * (1 + F.col("target_pct") / 100))
    gap = pct_change_abs("projection", "target")
    return rows.select("*", (F.col("projection") - F.col("target")).alias("gap"), gap.alias("gap_pct")).withColumn(
        "tone", F.when(to_tenth("gap_pct") >= 0, "good").when(to_tenth("gap_pct") >= -5, "warn").otherwise("bad"))


def owner_summary(rows: DataFrame) -> DataFrame:
    """Owners on track and at risk, and the aggregate gap."""
    cents = lambda c: F.sum(F.round(c, 2).cast("decimal(28,2)"))
    row = rows.agg(
        F.count("*").alias("owners"), F.count_if(to_tenth("gap_pct") >= 0).alias("on_track"), F.count_if(to_tenth("gap_pct") < -5).alias("at_risk"),
        cents("projection").alias("p"), cents("target").alias("t"),
        F.min(F.struct("gap", "seller", "gap_pct")).alias("worst"),
    )
    return row.select(
        "owners", "on_track", "at_risk", dbl("p").alias("projection"), dbl("t").alias("target"), dbl(F.col("p") - F.col("t")).alias("gap"),
        pct_change_abs("p", "t").alias("gap_pct"), F.col("worst.seller").alias("worst_seller"), F.col("worst.gap_pct").alias("worst_gap_pct"),
    )


def owner_alerts(summary: DataFrame, critical_gap: float = -50_000_000.0) -> DataFrame:
    rules = [
        (("responsables bajo plan",), F.when(F.col("gap") <= critical_gap, "critical").otherwise("warn"), F.col("gap") < 0, "gap", F.lit(None).cast("string")),
        (("mayor desvío",), F.lit("warn"), to_tenth("worst_gap_pct") < -8, "worst_gap_pct", F.col("worst_seller")),
    ]
    return _alerts(summary, rules)
