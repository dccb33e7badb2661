"""Edge rules on small hand-made frames, checked by hand or against a brute-force count."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ventara.operators import analyses, core, filters, focus, history, profile, tactical
from ventara.plans.period import MonthWindow, Period, load_window, month_labels, next_labels, resolve_period

PERIOD = Period(date(2024, 5, 1), date(2024, 5, 31), date(2024, 4, 1), date(2024, 4, 30))
COLUMNS = (
    "date date, client_key string, client string, client_canonical string, invoice string, family string, channel string, seller_name string, "
    "sales_force string, route_description string, amount decimal(18,4), quantity decimal(18,4)"
)


def fact_of(spark, rows):
    """rows: (day, client, invoice, family, seller, amount)."""
    data = [(d, c, c.upper(), c, i, f, "Canal", s, "F", None, Decimal(str(a)), Decimal(1)) for d, c, i, f, s, a in rows]
    return spark.createDataFrame(data, COLUMNS).withColumns({"period": F.date_format("date", "yyyy-MM"), "client_name": F.col("client")})


def random_fact(spark, seed, clients=12, n=300):
    rng = random.Random(seed)
    start = date(2023, 1, 1)
    return [
        (start + timedelta(days=rng.randrange(500)), f"c{min(rng.randrange(clients), rng.randrange(clients))}", f"i{rng.randrange(80)}", rng.choice(["A", "B", None]), rng.choice(["S1", "S2"]), rng.randrange(1, 1000))
        for _ in range(n)
    ]


def test_one_purchase_gives_the_default_gap(spark):
    row = core.client_stats(fact_of(spark, [(date(2024, 5, 10), "a", "1", "A", "S1", 10)]), PERIOD).first()
    assert (row.avg_gap_days, row.status, row.orders, row.families, row.sales) == (45.0, "Activo", 1, 1, 10.0)


def test_client_without_current_purchases_uses_its_history(spark):
    fact = fact_of(spark, [(date(2024, 1, 1), "a", "1", "A", "S1", 10), (date(2024, 1, 11), "a", "2", "B", "S1", 30), (date(2024, 6, 30), "a", "3", "C", "S2", 7), (date(2024, 7, 1), "a", "4", "C", "S2", 7), (date(2024, 7, 2), "a", "5", "C", "S2", 7)])
    row = core.client_stats(fact, PERIOD).first()
    assert (row.orders, row.families, row.sales, row.history_sales, row.avg_ticket) == (2, 2, 0.0, 40.0, 20.0)
    assert (row.avg_gap_days, row.recency_days, row.status) == (10.0, 141, "Perdido")
    assert row.seller_name == "S2"  # the usual seller counts all rows, later ones too


def test_tied_usual_value_is_the_smallest(spark):
    fact = fact_of(spark, [(date(2024, 5, 1), "a", "1", "A", "S2", 1), (date(2024, 5, 2), "a", "2", "A", "S1", 1)])
    assert core.client_stats(fact, PERIOD).first().seller_name == "S1"


def test_missing_dimension_gets_its_label(spark):
    rows = core.dimension_stats(fact_of(spark, [(date(2024, 5, 1), "a", "1", None, "S1", 5)]), PERIOD, ("family", "route_description")).collect()
    assert {(r.dimension, r.label, r.sales, r.growth_pct) for r in rows} == {("family", "Sin familia", 5.0, 100.0), ("route_description", "Sin ruta", 5.0, 100.0)}


def test_empty_selection_matches_nothing_and_unknown_fields_are_ignored(spark):
    fact = fact_of(spark, random_fact(spark, 1))
    assert filters.apply_filters(fact, {"channel": []}).count() == 0
    assert filters.apply_filters(fact, {"nope": ["x"]}).count() == fact.count()
    assert filters.apply_filters(fact, {"family": [" a ", "SIN FAMILIA"]}).count() == fact.filter("family = 'A' or family is null").count()


def test_filter_selection_forms(spark):
    assert filters.clean_selection("month", ["Mayo", "6", 13, ""]) == ["5", "6"]
    assert filters.clean_selection("year", ["2024", "24", 2023]) == ["2024", "2023"]
    assert filters.focus_supplier({"supplier": ["A", "b"]}, " B ")["supplier"] == ["b"]
    assert filters.focus_supplier({}, "B")["supplier"] == ["B"]
    assert filters.focus_supplier({"supplier": ["A"]}, "B")["supplier"] == []


def test_filters_without_effect_go_and_broad_ones_are_relaxed(spark):
    fact = fact_of(spark, random_fact(spark, 2)).withColumn("supplier", F.concat(F.lit("P"), F.col("invoice").substr(2, 1)))
    every = [r.supplier for r in fact.select("supplier").distinct().collect()]
    assert "supplier" not in filters.remove_no_effect(fact, {"supplier": every})
    most = every[: len(every) - 1] if len(every) >= 8 else every
    assert "supplier" not in filters.relax_broad(fact, {"supplier": most})
    assert "supplier" in filters.relax_broad(fact, {"supplier": every[:1]})


@pytest.mark.parametrize("seed", [3, 4])
def test_cohorts_against_sets(spark, seed):
    rows = random_fact(spark, seed)
    got = {r.period: r for r in history.cohorts(fact_of(spark, rows)).collect()}
    months = sorted({f"{d:%Y-%m}" for d, *_ in rows})
    seen, before = set(), set()
    for month in months:
        now = {c for d, c, *_ in rows if f"{d:%Y-%m}" == month}
        r = got[month]
        assert (r.new, r.active, r.recovered, r.lost, r.current_clients) == (len(now - seen), len(now & before), len((now - before) & seen), len(before - now), len(now))
        assert r.current_clients == r.new + r.active + r.recovered
        seen, before = seen | now, now


def test_running_totals_over_many_partitions_with_ties(spark):
    values = [(f"c{i:03d}", Decimal(i % 7)) for i in range(500)]
    df = spark.createDataFrame(values, "client string, exact decimal(18,4)").repartition(7)
    got = history.running_totals(df, [F.desc("exact"), "client"], "exact").orderBy("rank").collect()
    total = Decimal(0)
    for i, (client, value) in enumerate(sorted(values, key=lambda x: (-x[1], x[0])), 1):
        total += value
        assert (got[i - 1].rank, got[i - 1].client, got[i - 1].running) == (i, client, total)


def test_pareto_ends_at_one_hundred(spark):
    rows = history.pareto(fact_of(spark, random_fact(spark, 5))).orderBy("rank").collect()
    assert rows[-1].cumulative_pct == pytest.approx(100.0)
    assert sum(r.share_pct for r in rows) == pytest.approx(100.0)


@pytest.mark.parametrize("seed", [6, 7])
def test_client_movement_against_sets(spark, seed):
    rows, m = random_fact(spark, seed, clients=40), MonthWindow(date(2024, 3, 31))
    got = tactical.client_movement(fact_of(spark, rows), m).first()
    buys = lambda a, b: {c for d, c, *_ in rows if a <= d <= b}
    cur, prev, full = buys(m.start, m.as_of), buys(m.previous_start, m.previous_end), buys(m.previous_start, m.previous_full_end)
    past = buys(date(1900, 1, 1), m.start - timedelta(days=1))
    assert (got.active, got.without_purchase, got.dropped, got.recovered, got.new) == (len(cur), len(full - cur), len(prev - cur), len((cur & past) - full), len(cur - past))


def test_objective_without_history_is_zero(spark):
    row = tactical.objective(fact_of(spark, [(date(2024, 5, 2), "a", "1", "A", "S1", 5)]), MonthWindow(date(2024, 5, 20))).first()
    assert (row.objective_sales, row.objective_units) == (0.0, 0.0)


def test_trend_with_few_months_uses_what_there_is(spark):
    fact = fact_of(spark, [(date(2024, m, 1), "a", str(m), "A", "S1", 100 * m) for m in (1, 2, 3, 4)])
    row = analyses.trend_outlook(fact).orderBy("forecast_period").first()
    assert (row.last3_avg, row.prev3_avg, row.trend_pct, row.forecast_period) == (300.0, 100.0, 200.0, "2024-05")
    assert row.forecast == pytest.approx(300 * 1.12)
    lone = analyses.trend_outlook(fact.filter("period = '2024-01'")).first()
    assert (lone.last3_avg, lone.prev3_avg, lone.trend_pct) == (100.0, 100.0, 0.0)


def test_seller_lost_to_the_comparison_is_listed(spark):
    fact = fact_of(spark, [(date(2024, 5, 1), "a", "1", "A", "S1", 10), (date(2024, 4, 1), "b", "2", "A", "S2", 10)])
    rows = {r.seller: r for r in focus.sellers_dashboard(fact, PERIOD).collect()}
    assert (rows["S2"].sales, rows["S2"].growth_pct, rows["S2"].client_delta, rows["S2"].dropped_clients, rows["S2"].status) == (0.0, -100.0, -1, 1, "En riesgo")
    assert (rows["S1"].recovered_clients, rows["S1"].top3_clients_pct, rows["S1"].status) == (1, 100.0, "Sólido")


def test_margin_without_dimension_gives_the_total(spark):
    fact = fact_of(spark, random_fact(spark, 8)).withColumn("cost", (F.col("amount") / 2).cast("decimal(18,4)"))
    rows = analyses.margin_analysis(fact).collect()
    assert {r.label for r in rows} == {"Total"} and all(r.margin_pct == pytest.approx(50.0) for r in rows)


def test_run_all_keeps_going_when_one_analysis_fails(spark):
    frames, errors = analyses.run_all(fact_of(spark, random_fact(spark, 9)))
    assert set(errors) == {"margin_analysis"} and "temporal_trend" in frames


def test_profile_skips_empty_columns_and_booleans_are_no_metric(spark):
    df = spark.createDataFrame([(True, None, "x"), (True, "Sin familia", "y")], "flag boolean, family string, nombre_cliente string")
    rows = {r.field: r for r in profile.profile(df).collect()}
    assert set(rows) == {"flag", "nombre_cliente"} and rows["flag"].role != "MÉTRICA" and rows["nombre_cliente"].role == "IDENTIFICADOR"


def test_periods():
    m = MonthWindow(date(2024, 3, 31))
    assert (m.previous_end, m.previous_full_end, m.year_ago_end) == (date(2024, 2, 29), date(2024, 2, 29), date(2023, 3, 31))
    assert MonthWindow(date(2024, 2, 29)).year_ago_end == date(2023, 2, 28)
    assert (m.elapsed, m.days, m.remaining) == (31, 31, 0)
    assert month_labels(date(2023, 12, 5), date(2024, 2, 1)) == ["2023-12", "2024-01", "2024-02"]
    assert next_labels("2024-11", 3) == ["2024-12", "2025-01", "2025-02"]
    assert load_window(PERIOD) == (date(2024, 4, 1), date(2024, 5, 31))
    assert load_window(PERIOD, True)[0] == date(2023, 5, 1)


def test_period_defaults_to_the_span_of_the_fact(spark):
    p = resolve_period(fact_of(spark, [(date(2024, 5, 1), "a", "1", "A", "S1", 1), (date(2024, 5, 10), "a", "1", "A", "S1", 1)]))
    assert (p.selected_start, p.selected_end, p.comparison_start, p.comparison_end, p.days) == (date(2024, 5, 1), date(2024, 5, 10), date(2024, 4, 21), date(2024, 4, 30), 10)


def test_board_actions_follow_the_texts(spark):
    from ventara.operators import board

    role = spark.createDataFrame([(1, "Supervisión", "Ruta debilitada", "warn", 1.0, "R1"), (2, "Canales", "Canal con baja rotación", "warn", 1.0, "C1"), (3, "Jefatura ventas", "Vendedor a corregir", "warn", 1.0, "V")], "rule int, role string, topic string, severity string, value double, label string")
    others = {
        "sellers": [("vendedor en caída", "S"), ("dependencia", None)], "history": [("concentración", None), ("caída mensual", None)],
        "opportunities": [("canales bajo promedio", None)], "budget": [("último mes bajo plan", None)],
    }
    frames = {b: spark.createDataFrame([(b, "warn", t, 1.0, label) for t, label in rows], "board string, severity string, topic string, value double, label string") for b, rows in others.items()}
    rows = board.direction_board(role, frames, 20).collect()
    actions = {(r.area, r.topic): r.action for r in rows}
    recover = {("Supervisión", "Ruta debilitada"), ("Canales", "Canal con baja rotación"), ("Vendedores", "vendedor en caída"), ("Histórico", "concentración"), ("Oportunidad", "canales bajo promedio")}
    assert {k for k, v in actions.items() if v == "recuperación de cartera"} == recover
    assert actions["Vendedores", "dependencia"] == actions["Jefatura ventas", "Vendedor a corregir"] == "meta del responsable"
    assert actions["Histórico", "caída mensual"] == "acción correctiva" and actions["Presupuesto", "último mes bajo plan"] == "ajuste de presupuesto"
    assert [r.topic for r in rows if r.area == "Histórico"] == ["caída mensual", "concentración"]


def test_run_all_isolates_errors_of_running_analyses(spark):
    fact = fact_of(spark, random_fact(spark, 9)).withColumn("channel", F.raise_error(F.lit("bad cell")).cast("string"))
    frames, errors = analyses.run_all(fact, ("temporal_trend", "channel_analysis"), keep=True)
    assert set(frames) == {"temporal_trend"} and set(errors) == {"channel_analysis"}
