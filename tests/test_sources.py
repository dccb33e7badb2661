from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from books import write_book
from ventara.sources import erp, mapping, normalise, store, workbook

SALES = "date date, client_key string, invoice string, product_key string, seller_key string, channel string, amount decimal(18,4), quantity decimal(18,4)"


def lines(spark, *rows):
    return spark.createDataFrame([(d, c, i, "p", "s", "ch", Decimal(str(a)), Decimal(1)) for d, c, i, a in rows], SALES)


def stored(spark, path):
    return sorted((r.date, r.client_key, r.invoice, float(r.amount)) for r in store.read_sales(spark, path).collect())


def test_workbook_rows_headers_and_sales(spark, tmp_path):
    write_book(tmp_path / "enero.xlsx", {
        "Ventas": [
            ["Reporte"], [None, None], ["Fecha", "Cod cliente", "Importe", None],
            [("date", 45322), 12, "1.234,50", True], ["15/02/2024", "b 1", 7.5, False], ["x", "c", 1, None], [("date", 45322.5), 0, 1, ("inline", "nota")],
        ],
        "Otra": [["a"]],
    })
    write_book(tmp_path / "febrero.xlsx", {"Ventas": [["Fecha", "Cod cliente", "Importe"], ["2024-02-01", "z", "3"]]})
    rows = workbook.read_workbooks(spark, str(tmp_path), "Ventas")
    first = {r.row_no: r.cells for r in rows.filter("file like '%/enero.xlsx'").collect()}
    assert first[0] == ["Reporte"] and len(first) == 6  # the blank row is gone
    assert first[2][:3] == ["2024-01-31", "12", "1.234,50"] and first[2][3] == "True" and first[5][0] == "2024-01-31 12:00" and first[5][3] == "nota"
    base = lambda f: f.rsplit("/", 1)[-1]
    heads = {base(r.file): (r.header_row, r.headers) for r in workbook.header_rows(rows).collect()}
    assert heads["enero.xlsx"][0] == 1 and heads["febrero.xlsx"] == (0, ["Fecha", "Cod cliente", "Importe"])
    data = workbook.data_rows(rows)
    sales = normalise.normalise_sales(data, {"date": 0, "client_key": 1, "amount": 2}).orderBy("date").collect()
    assert [(r.date, r.client_key, float(r.amount), base(r.source)) for r in sales] == [
        (date(2024, 1, 31), "12", 1234.5, "enero.xlsx"), (date(2024, 2, 1), "Z", 3.0, "febrero.xlsx"), (date(2024, 2, 15), "B 1", 7.5, "enero.xlsx")]
    assert sales[0].invoice.endswith("/enero.xlsx-12-2024-01-31-1")
    counts = {base(r.source): (r.rows_read, r.rows_valid) for r in normalise.source_counts(rows, normalise.normalise_sales(data, {"date": 0, "client_key": 1, "amount": 2})).collect()}
    assert counts == {"enero.xlsx": (6, 2), "febrero.xlsx": (2, 1)}
    hints = {r.field: r.column for r in mapping.suggest_mapping(workbook.header_rows(rows)).filter("file like '%/febrero.xlsx'").collect()}
    assert (hints["date"], hints["client_key"], hints["amount"]) == (0, 1, 2)
    assert workbook.preview_sheet(spark, str(tmp_path / "enero.xlsx"), "Ventas", 2).count() == 2


def test_missing_sheet_is_an_error(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", {"Uno": [["x"]]})
    with pytest.raises(Exception, match="no sheet"):
        workbook.read_workbooks(spark, str(tmp_path), "Dos").collect()


def test_mapping_must_hold_the_required_fields():
    assert mapping.check_mapping("sales", {"client_key": 0, "amount": "2", "year": 1, "month": 3, "channel": -1}) == {"year": 1, "month": 3, "client_key": 0, "amount": 2}
    for bad in ({"amount": 1, "date": 0}, {"client_key": 0, "amount": 1, "year": 2}):
        with pytest.raises(ValueError):
            mapping.check_mapping("sales", bad)
    with pytest.raises(ValueError):
        mapping.check_mapping("articles", {"family": 1})


def test_erp_json_is_read_with_the_declared_schema(spark, tmp_path):
    (tmp_path / "v.json").write_text(
        '{"fechaPedido":"2024-05-02T00:00:00","idCliente":7,"totalFinal":12.5,"idLinea":"3","idDocumento":1,"serie":2}\n'
        '{"anulado":"SI","fechaPedido":"2024-05-02","idCliente":7,"totalFinal":1}\n{"fechaPedido":"","idCliente":7,"totalFinal":1}\n')
    rows = erp.erp_sales(erp.read_erp_json(spark, str(tmp_path), erp.text_schema(erp.SALE_FIELDS))).collect()
    assert [(r.client_key, float(r.amount), r.detail_level, r.invoice, r.date) for r in rows] == [("7", 12.5, "line", "1-2", date(2024, 5, 2))]


def test_sync_replaces_only_its_range_and_is_repeatable(spark, tmp_path):
    path, log = str(tmp_path / "sales"), str(tmp_path / "log")
    store.sync_range(spark, path, lines(spark, (date(2024, 1, 10), "a", "1", 5), (date(2024, 1, 20), "b", "2", 6), (date(2024, 2, 3), "c", "3", 7)), date(2024, 1, 1), date(2024, 2, 29), log)
    fresh = lines(spark, (date(2024, 1, 12), "d", "4", 1), (date(2024, 1, 12), "d", "4", 2), (date(2024, 3, 1), "out", "9", 9))
    for _ in range(2):
        store.sync_range(spark, path, fresh, date(2024, 1, 5), date(2024, 1, 15), log)
        assert stored(spark, path) == [(date(2024, 1, 12), "d", "4", 3.0), (date(2024, 1, 20), "b", "2", 6.0), (date(2024, 2, 3), "c", "3", 7.0)]
    runs = spark.read.schema(store.RUN_SCHEMA).parquet(log)
    assert runs.count() == 3 and store.latest_runs(runs, 1).first().records_received == 2  # lines received, before compaction


def test_empty_sync_needs_a_confirmation_and_then_clears_the_month(spark, tmp_path):
    path, log = str(tmp_path / "sales"), str(tmp_path / "log")
    start, end = date(2024, 2, 1), date(2024, 2, 29)
    store.sync_range(spark, path, lines(spark, (date(2024, 1, 10), "a", "1", 5), (date(2024, 2, 3), "c", "3", 7)), date(2024, 1, 1), end)
    nothing = lines(spark, (date(2025, 1, 1), "x", "1", 1))
    with pytest.raises(RuntimeError):
        store.sync_range(spark, path, nothing, start, end, log)
    assert len(stored(spark, path)) == 2
    store.sync_range(spark, path, nothing, start, end, log, warning="La API no devolvió ventas")
    assert stored(spark, path) == [(date(2024, 1, 10), "a", "1", 5.0)]
    statuses = [r.status for r in spark.read.schema(store.RUN_SCHEMA).parquet(log).orderBy("timestamp").collect()]
    assert statuses == ["aborted_empty_response", "success"]


def test_scan_prunes_months_and_reports_an_empty_range(spark, tmp_path):
    path = str(tmp_path / "sales")
    store.sync_range(spark, path, lines(spark, *[(date(2024, m, 1), "a", str(m), m) for m in range(1, 7)]), date(2024, 1, 1), date(2024, 6, 30))
    rows = store.scan_range(spark, path, date(2024, 2, 1), date(2024, 3, 15), ordered=True)
    assert [r.date.month for r in rows.collect()] == [2, 3]
    assert {f.split("month=")[1].split("/")[0] for f in rows.inputFiles()} == {"2", "3"}
    with pytest.raises(ValueError):
        store.scan_range(spark, path, date(2030, 1, 1), date(2030, 1, 2))


def test_retention_drops_old_months_and_cuts_the_first_one(spark, tmp_path):
    path = str(tmp_path / "sales")
    store.sync_range(spark, path, lines(spark, *[(date(2024, m, d), "a", f"{m}{d}", m) for m in (1, 2, 3) for d in (5, 25)]), date(2024, 1, 1), date(2024, 3, 31))
    store.prune_store(spark, path, store.retention_cutoff(date(2024, 3, 31), 47))
    assert [r[0] for r in stored(spark, path)] == [date(2024, 2, 25), date(2024, 3, 5), date(2024, 3, 25)]
    assert store.retention_cutoff(date(2024, 3, 31), 0) is None


def test_masters_are_updated_or_replaced(spark, tmp_path):
    path = str(tmp_path / "articles")
    frame = lambda *rows: spark.createDataFrame(list(rows), "product_key string, brand string")
    read = lambda: sorted(tuple(r) for r in store.read_master(spark, path).collect())
    store.write_master(frame(("1", "a"), ("2", "b"), ("", "x")), path, "product_key")
    store.write_master(frame(("2", "B"), ("3", "c")), path, "product_key")
    assert read() == [("1", "a"), ("2", "B"), ("3", "c")]
    store.write_master(frame(("9", "z")), path, "product_key", replace_all=True)
    assert read() == [("9", "z")]


RUNS = "entity string, status string, range_start date, range_end date, records_received long, empty_confirmed boolean"


def day(n):
    return date(2024, 1, n)


def runs_of(spark, *rows):
    return spark.createDataFrame([("sales", s, a, b, n, e) for s, a, b, n, e in rows], RUNS)


def test_ranges_that_touch_become_one(spark):
    runs = runs_of(spark, ("success", day(1), day(5), 1, False), ("success", day(6), day(8), 0, True), ("failed", day(9), day(12), 1, False), ("success", day(12), day(14), 0, False),
                   ("success", day(15), day(30), 2, False), ("success", day(16), day(18), 2, False))
    ranges = lambda df: sorted((r.start.day, r.end.day) for r in df.collect())
    assert ranges(store.covered_ranges(runs, day(2), day(20))) == [(2, 8), (15, 20)]
    missing = store.uncovered_ranges(runs, day(2), day(20))
    assert ranges(missing) == [(9, 14)]
    assert ranges(store.reused_ranges(missing, day(2), day(20))) == [(2, 8), (15, 20)]
    row = store.range_coverage(runs, day(2), day(20)).first()
    assert (row.covered, row.missing_start, row.missing_end) == (False, day(9), day(14))
    assert store.range_coverage(runs, day(16), day(20)).first().covered
    assert ranges(store.uncovered_ranges(runs.filter("status = 'none'"), day(2), day(20))) == [(2, 20)]


def test_fallback_to_the_history_store(spark, tmp_path):
    main, long = str(tmp_path / "main"), str(tmp_path / "long")
    store.sync_range(spark, main, lines(spark, (day(3), "a", "1", 1)), day(1), day(5))
    store.sync_range(spark, long, lines(spark, (day(3), "a", "1", 1), (day(9), "b", "2", 1)), day(1), day(10))
    runs = runs_of(spark, ("success", day(1), day(5), 1, False))
    assert store.load_with_fallback(spark, runs, main, long, day(2), day(4))[1] == "main"
    rows, source = store.load_with_fallback(spark, runs, main, long, day(2), day(10))
    assert source == "history" and rows.count() == 2


def test_compaction_keeps_the_sums(spark):
    df = lines(spark, (day(1), "a", "1", 1.5), (day(1), "a", "1", 2.25), (day(2), "a", "1", 4)).withColumn("client_name", F.lit(""))
    rows = store.compact(df).orderBy("date").collect()
    assert [(float(r.amount), float(r.amount_net), float(r.quantity), r.client_name) for r in rows] == [(3.75, 3.75, 2.0, "a"), (4.0, 4.0, 1.0, "a")]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for year, head in (("2023", ["Importe", "Cod cliente", "Fecha"]), ("2024", ["Fecha", "Cod cliente", "Importe"])):
        (tmp_path / year).mkdir()
        write_book(tmp_path / year / "ventas.xlsx", {"Ventas": [head, ["x", "y", "z"]]})
    heads = {r.file.rsplit("/", 2)[-2]: r.headers[0] for r in workbook.header_rows(workbook.read_workbooks(spark, str(tmp_path))).collect()}
    assert heads == {"2023": "Importe", "2024": "Fecha"}
    assert workbook.header_rows(workbook.read_workbooks(spark, str(tmp_path))).select(workbook.file_label()).distinct().count() == 1


def test_last_record_is_that_of_the_last_file(spark, tmp_path):
    record = '{"idArticulo": "1", "desArticulo": "%s"}\n'
    (tmp_path / "01.json").write_text(record % "old")
    (tmp_path / "02.json").write_text(record % "new" + '{"idArticulo": "2", "desArticulo": "other"}\n' * 500)
    (tmp_path / "03.json").write_text('{"idArticulo": "3", "desArticulo": "x"}\n')
    rows = erp.erp_articles(erp.read_erp_json(spark, str(tmp_path), erp.ARTICLE_SCHEMA))
    assert {r.product_key: r.product_name for r in rows.collect()}["1"] == "new"


def test_upsert_keeps_one_row_per_key(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v string, load_seq int")
    got = store.upsert(frame(("1", "a", 0), ("2", "b", 0)), frame(("2", "x", 2), ("2", "y", 1), (" ", "z", 3)), "k").collect()
    assert sorted((r.k, r.v) for r in got) == [("1", "a"), ("2", "x")]


def test_runs_of_other_entities_do_not_cover_sales(spark):
    runs = spark.createDataFrame([("articles", "success", day(1), day(20), 5, False), ("sales", "success", day(1), day(3), 5, False)], RUNS)
    row = store.range_coverage(runs, day(1), day(10)).first()
    assert (row.covered, row.missing_start) == (False, day(4))
    assert store.range_coverage(runs, day(1), day(10), entity="articles").first().covered


def test_received_lines_are_counted_before_compaction(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lines(spark, (day(3), "a", "1", 1), (day(3), "a", "1", 2))
    assert store.sync_range(spark, path, rows, day(1), day(5))["records_received"] == 2
    assert store.sync_range(spark, path, rows.withColumns({"document_key": F.lit("d"), "line_key": F.lit("l")}), day(1), day(5), full_detail=True)["records_received"] == 2
    assert [float(r.amount) for r in store.scan_range(spark, path, day(1), day(5)).collect()] == [3.0]


def test_numbers_are_kept_or_refused(spark):
    from ventara.functions.numbers import parse_erp_number, parse_number

    cells = ["123456789012345,10", "1,123456", "1.234,5", "n/a", "", None, "1" * 25 + "." + "2" * 3 + ",5"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    text = lambda f: [None if r[0] is None else str(r[0]) for r in df.select(f("c")).collect()]
    assert text(parse_number)[:6] == ["123456789012345.100000", "1.123456", "1234.500000", None, None, None]
    assert text(parse_erp_number)[6] == "1" * 25 + "222.500000"
    with pytest.raises(Exception, match="number beyond"):
        spark.createDataFrame([("9" * 40,)], "c string").select(parse_number("c")).collect()
