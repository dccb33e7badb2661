"""What the large joins and aggregates shuffle."""

import random
import re
from datetime import date
from decimal import Decimal

import pytest

import __spark_entry__ as entry

from checks import dashboard_checks, enrich_checks, fixtures, source_checks
from executions import Executions
from pyspark.sql import functions as F
from ventara.operators import analyses, core, enrich, profile, report
from ventara.plans.period import Period
from ventara.sources import store

PERIOD = Period(date(2001, 5, 1), date(2001, 7, 31), date(2001, 1, 29), date(2001, 4, 30))


@pytest.fixture
def large(spark):
    """Joins as of tables too large to be broadcast."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above_joins(df):
    return plan(df).split("SortMergeJoin")[0]


def test_sales_grain_needs_no_shuffle_after_the_joins(large, sf_dir):
    assert "Exchange" not in above_joins(core.sales_grain(fixtures.fact(large, sf_dir)))


def test_compaction_shuffles_its_lines_once(large, sf_dir):
    assert above_joins(store.compact(fixtures.fact(large, sf_dir))).count("Exchange") == 1


def test_merged_batch_reads_the_lines_once(large, sf_dir):
    assert plan(source_checks._batch(source_checks._detail(fixtures.fact(large, sf_dir)))).count("l_extendedprice#") > 0
    assert plan(source_checks._batch(source_checks._detail(fixtures.fact(large, sf_dir)))).count("FileScan parquet [l_orderkey") == 1


def test_enrich_broadcasts_lookups_counted_to_be_small(large, sf_dir, monkeypatch):
    build = lambda: plan(enrich.enrich(*[f(large, sf_dir) for f in (enrich_checks.raw_sales, enrich_checks.articles, enrich_checks.routes, enrich_checks.sellers)]))
    assert build().count("BroadcastHashJoin") == 5
    monkeypatch.setattr(enrich, "BROADCAST_ROWS", 0)
    assert "BroadcastHashJoin" not in build()


def test_orders_outside_the_period_keep_labels_and_sums_only(spark):
    rows = [(date(2001, 6, 1), "a", "1", "x"), (date(2001, 6, 1), None, "2", "x"), (None, "a", "9", "y"), *[(date(2001, 2, 1), "a", str(k), "x") for k in range(40)], (date(1999, 1, 1), "b", "3", "old")]
    fact = spark.createDataFrame(rows, "date date, client_key string, invoice string, channel string").withColumns({m: F.lit(1).cast("decimal(38,6)") for m in ("amount", "quantity")})
    stats = core.dimension_stats(fact, PERIOD, ("channel",))
    found = {r.label: (int(r.sales), int(r.previous_sales), r.clients, r.orders) for r in stats.collect()}
    assert found == {"x": (2, 40, 1, 2), "y": (0, 0, 0, 0), "old": (0, 0, 0, 0)}
    text = stats._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("THEN client_key") or "THEN cast(client_key" in text


def test_kept_grain_of_opportunities_has_only_what_they_read(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(dashboard_checks, "kept", lambda df: seen.append(df.columns) or df)
    dashboard_checks._opps(fixtures.fact(spark, sf_dir))
    assert "lines" in seen[0] and not {"supplier", "brand", "client_name", "year"} & set(seen[0])


def test_kept_grain_is_not_grouped(large, sf_dir):
    assert "Aggregate" not in above_joins(core.sales_grain(fixtures.fact(large, sf_dir)))


def test_grain_stands_for_every_line(spark):
    fact = spark.createDataFrame([("1", "x", 2), ("1", "x", 3), ("1", None, None)], "invoice string, channel string, amount int")
    grain = core.sales_grain(fact, ("channel",), ("amount",), ("invoice",))
    assert grain.agg(F.sum("lines"), F.sum("amount").cast("int")).first()[:] == (3, 5) and grain.columns == ["invoice", "channel", "amount", "lines"]


def test_suppliers_counted_to_be_few_do_not_shuffle_the_lines(large, sf_dir, monkeypatch):
    assert plan(fixtures.fact(large, sf_dir)).count("BroadcastHashJoin") == 1
    monkeypatch.setattr(fixtures, "BROADCAST_SUPPLIERS", 0)
    assert "BroadcastHashJoin" not in plan(fixtures.fact(large, sf_dir))


def test_client_stats_shuffle_the_combinations_once(large):
    fact = large.createDataFrame([], "date date, period string, client_key string, client string, invoice string, sales_force string, route_description string, seller_name string, family string, amount decimal(38,6), quantity decimal(38,6)")
    assert len(re.findall(r"Exchange hashpartitioning\(client_key#\d+, client#\d+, sales_force", plan(core.client_stats(fact, PERIOD)))) == 1


def test_name_of_the_last_day_comes_with_the_usual_values(spark):
    rows = [("a", "old", "n", 9, date(2001, 1, 1)), ("a", "new", "s", 1, date(2001, 2, 1)), ("a", "none", "s", 1, None), ("b", "x", "s", 1, None), (None, "y", None, 2, date(2001, 1, 1))]
    combos = spark.createDataFrame(rows, "client_key string, client string, force string, n int, day date")
    found = {r.client_key: (r.force, r.last and r.last.client) for r in core.usual_values(combos, "client_key", ("force",), latest=("client", "day")).collect()}
    assert found == {"a": ("n", "new"), "b": ("s", None), None: (None, "y")}


def test_run_task_joins_the_lines_once(spark, sf_dir):
    seen = Executions(spark)
    entry.queries()["run_task"](spark, sf_dir).collect()
    assert seen.scans("lineitem") == 1


@pytest.mark.parametrize("name", ("board_kpis", "direction_board"))
def test_kept_grain_of_the_board_has_only_what_it_reads(spark, sf_dir, monkeypatch, name):
    class Seen(Exception):
        pass

    def stop(df):
        raise Seen(*df.columns)

    monkeypatch.setattr(fixtures, "kept", stop)
    with pytest.raises(Seen) as found:
        entry.queries()[name](spark, sf_dir)
    assert "lines" in found.value.args and not {"brand", "business_unit", "month", "has_article_match"} & set(found.value.args)


def test_lines_meet_orders_with_the_labels_of_their_article_only(large, sf_dir):
    grain = core.sales_grain(fixtures.fact(large, sf_dir), core.REPORT_LABELS, identities=core.REPORT_IDENTITIES)
    assert not {"p_name", "p_type", "p_partkey"} & set(re.findall(r"[a-z_]+", above_joins(grain)))


def test_report_keeps_measures_as_they_come_and_sums_them_exactly(spark, monkeypatch):
    row = [(date(2001, 6, 1), "2001-06", "a", "A", "1", *["x"] * 7, True, True, "0.000001", "1.50"), (date(2001, 2, 1), "2001-02", "a", "A", "2", *[None] * 7, False, False, None, None)]
    names = (*core.REPORT_IDENTITIES, *core.REPORT_LABELS, "amount", "quantity")
    types = ["date", *["string"] * 11, "boolean", "boolean", "string", "string"]
    fact = spark.createDataFrame(row, ", ".join(f"{n} {t}" for n, t in zip(names, types))).withColumns({"amount": F.col("amount").cast("decimal(18,6)"), "quantity": F.col("quantity").cast("decimal(18,2)")})
    seen, keep = [], report.kept
    monkeypatch.setattr(report, "kept", lambda df: seen.append(df) or keep(df))
    base = report.report_base(fact, PERIOD, keep=True)
    assert dict(seen[0].dtypes)["quantity"] == "decimal(18,2)" and seen[0].columns[-3:] == ["family", "brand", "business_unit"]
    assert dict(base.fact.dtypes)["quantity"] == "decimal(38,6)" and base.fact.agg(F.sum("lines")).first()[0] == 2
    assert base.clients.select("sales", "quantity").first()[:] == (Decimal("0.000001"), Decimal("1.500000"))


def test_client_stats_move_counted_values_only(spark):
    rows = [(date(2001, 6, 1), "2001-06", "1", "f"), (date(2001, 2, 1), "2001-02", "2", "g"), (date(2001, 2, 1), "2001-02", None, None), (date(2001, 9, 1), "2001-09", "3", "h"), (None, None, "4", "i")]
    fact = spark.createDataFrame([(*r, key) for key in ("a", None) for r in rows] + [(date(2001, 2, 1), "2001-02", "2", "g", "b"), (date(2001, 9, 1), "2001-09", "3", "h", "c")], "date date, period string, invoice string, family string, client_key string")
    fact = fact.withColumns({c: F.lit("x") for c in ("client", "sales_force", "route_description", "seller_name")} | {m: F.lit(1).cast("decimal(38,6)") for m in ("amount", "quantity")})
    stats = core.client_stats(fact, PERIOD)
    found = {r.client_key: (r.months_active, r.orders, r.families, int(r.history_sales)) for r in stats.collect()}
    assert found == {"a": (1, 1, 1, 3), "b": (0, 1, 1, 1)}
    assert "max(seen" not in plan(stats)


def test_order_of_a_client_is_a_date_and_an_invoice(spark):
    rows = [(date(2001, 6, 1), k, i, "x") for k, i in (("a", "1"), ("a", " 1 "), (" a", "1"), ("b", "1"), ("b", None), (None, "1"), (None, None))] + [(date(2001, 6, 2), "a", "1", "x")]
    fact = spark.createDataFrame(rows, "date date, client_key string, invoice string, channel string").withColumns({m: F.lit(1).cast("decimal(38,6)") for m in ("amount", "quantity")})
    stats = core.dimension_stats(fact, PERIOD, ("channel",))
    assert stats.select("clients", "orders").first()[:] == (3, 7)
    assert not re.search(r"struct\(date, date#\d+, client", plan(stats))


LINES = "date date, client_key string, invoice string, line_key string, product_key string, amount decimal(18,4), quantity decimal(18,4)"


def _lines(spark, *rows):
    return spark.createDataFrame([(date(2024, m, d), c, i, k, "p", Decimal(a), Decimal(1)) for m, d, c, i, k, a in rows], LINES)


def test_lines_to_be_stored_are_shuffled_once_and_as_they_come(spark, tmp_path, monkeypatch):
    seen, write = [], store._write_months
    monkeypatch.setattr(store, "_write_months", lambda table, rows, *more: seen.append(rows) or write(table, rows, *more))
    store.sync_range(spark, str(tmp_path / "s"), _lines(spark, (1, 1, "a", "1", "1", 1), (2, 1, "a", "2", "1", 2)), date(2024, 1, 1), date(2024, 2, 29), full_detail=True)
    runs = Executions(spark)
    store.sync_range(spark, str(tmp_path / "s"), _lines(spark, (1, 2, "b", "1", "1", 1)), date(2024, 1, 1), date(2024, 2, 29), full_detail=True)
    before = plan(seen[0]).split("Exchange")
    assert len(before) == 2 and "line_id" not in before[1] and "decimal(38,6)" not in before[1]
    assert not any("REBALANCE" in text for text in runs.plans())


def test_pieces_of_a_month_keep_lines_of_one_id_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LEAST_PIECES", 64)
    rows = _lines(spark, (1, 1, "a|b", "c", "1", 1), (1, 1, "a", "b|c", "1", 2), (1, 1, " a ", "x", "1", 3), (1, 1, "a", " x", "1", 4), (1, 1, None, None, None, 5), (1, 1, "", "", "", 6))
    store.sync_range(spark, str(tmp_path / "s"), rows, date(2024, 1, 1), date(2024, 1, 31), full_detail=True)
    found = {r.line_id: int(r.amount) for r in store.read_sales(spark, str(tmp_path / "s")).collect()}
    assert found == {"2024-01-01|a|b|c|1|p": 3, "2024-01-01|a|x|1|p": 7, "2024-01-01|||||p|": 11}


def test_a_batch_without_a_range_is_read_once(spark, tmp_path):
    _lines(spark, (1, 1, "a", "1", "1", 1), (3, 1, "a", "2", "1", 2)).write.parquet(str(tmp_path / "batch.parquet"))
    runs = Executions(spark)
    made = store.merge_lines(spark, str(tmp_path / "s"), spark.read.parquet(str(tmp_path / "batch.parquet")))
    assert runs.scans("batch") == 1
    assert {k: (p.rows, p.first, p.last) for k, (p,) in made.parts.items()} == {"2024-01": (1, date(2024, 1, 1), date(2024, 1, 1)), "2024-03": (1, date(2024, 3, 1), date(2024, 3, 1))}


def test_tasks_read_the_lines_twice_and_make_no_value_lists(spark, sf_dir):
    seen = Executions(spark)
    entry.queries()["tasks"](spark, sf_dir).collect()
    assert 1 <= seen.scans("lineitem") <= 2
    assert not any("row_number" in text for text in seen.plans())


def test_profile_of_known_and_other_columns(spark):
    rows = [("x", " ", 3, "f", "1", None), ("x", "Sin canal", 4, None, "2", None), (None, "web", None, "f", "2", None), ("y", "web", 4, "g", "3", None)]
    df = spark.createDataFrame(rows, "client string, channel string, amount int, free string, code string, flavor string")
    found = {r.field: (r.role, r.subrole, r.coverage, r.cardinality, r.top_values and [tuple(x) for x in r.top_values]) for r in profile.profile(df, top=2).collect()}
    assert found == {
        "client": ("DIMENSIÓN", "DIM_CLIENTE", 0.75, 2, [("x", 2), ("y", 1)]), "channel": ("DIMENSIÓN", "DIM_CANAL", 0.5, 1, [("web", 2)]), "amount": ("MÉTRICA", "MET_VENTA", 0.75, None, None),
        "free": ("DIMENSIÓN", None, 0.75, 2, [("f", 2), ("g", 1)]), "code": ("DIMENSIÓN", None, 1.0, 3, [("2", 2), ("1", 1)])}
    assert [(r.field, r.role, r.cardinality) for r in profile.profile(df, ["amount", "flavor"]).collect()] == [("amount", "MÉTRICA", None)]
    assert not profile.profile(df.limit(0)).collect()
    assert plan(profile.profile(df).select("field", "role", "coverage")).count("row_number") == 0


def test_all_rankings_equal_a_plain_count(spark):
    pick = random.Random(4).choice
    # Orders of a client and channel of their own, orders that vary in some dimensions, and blank ones.
    rows = [(f"c{k % 5}", f"i{k % 9}", f"ch{k % 3}", pick(["f", "g", None]), "s", 1) for k in range(30)]
    rows += [(pick(["a", " a", "", None]), pick(["x", "x ", "y", "", None]), pick(["u", "v", " u", None]), pick(["f", "g", "h"]), pick(["s", "t"]), pick([1, 2, None])) for _ in range(60)]
    fact = spark.createDataFrame(rows, "client_key string, invoice string, channel string, family string, seller_name string, amount int")
    dims = ("channel", "family", "seller_name")
    found = {(r.combo, r.label): (r.value, r.clients, r.orders) for r in analyses.ranking_all_combos(fact, dims, top_n=100).collect()}
    want = {}
    for combo in [*((d,) for d in range(3)), (0, 1), (0, 2), (1, 2)]:
        for client, invoice, *labels, amount in rows:
            key = " / ".join(dims[d] for d in combo), " / ".join((labels[d] or "").strip() for d in combo)
            value, clients, orders = want.get(key, (0, set(), set()))
            want[key] = value + (amount or 0), clients | {(client or "").strip()}, orders | {(invoice or "").strip()}
    assert found == {k: (float(v), len(c), len(o)) for k, (v, c, o) in want.items()}


def test_all_rankings_do_not_repeat_the_lines_for_each_set(large, sf_dir):
    text = plan(entry.queries()["ranking_grouping_sets"](large, sf_dir))
    assert "Expand" not in text and text.count("FileScan parquet [l_orderkey") <= 3
