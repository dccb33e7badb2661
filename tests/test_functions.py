from datetime import date

import pytest
from pyspark.sql import functions as F

from ventara.functions import dates, numbers, text


def values(spark, inputs, expression):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_number_follows_the_last_mark(spark):
    got = values(spark, ["1.234,56", "1,234.56", "1234,5", "1234.5", "1.234.567,8", "1,2,3", " 12 ", "n/a", "", None, "-3,5", "1,234.5,6"], numbers.parse_number)
    assert [None if g is None else float(g) for g in got] == [1234.56, 1234.56, 1234.5, 1234.5, 1234567.8, None, 12.0, None, None, None, -3.5, None]


def test_parse_erp_number_groups_with_dots(spark):
    got = values(spark, ["1.234,56", "1,234.56", "12.5", "12,5", "x"], numbers.parse_erp_number)
    assert [None if g is None else float(g) for g in got] == [1234.56, 1.23456, 12.5, 12.5, None]


def test_erp_key(spark):
    assert values(spark, ["12.0", "12,00", "0", "", "007", "A1", "12.5", "1.234,00", "+5", " 9 ", None], text.erp_key) == [
        "12", "12", None, None, "7", "A1", "12.5", "1234", "5", "9", None]


def test_file_key_counts_zero_as_missing(spark):
    assert values(spark, [" ab ", "0", "", None], text.file_key) == ["AB", "", "", ""]


def test_folded(spark):
    assert values(spark, ["  Ñandú   ÁÉÍ ", None], text.folded) == ["nandu aei", ""]


def test_operational_route(spark):
    assert values(spark, ["0000 - 12", "000-X", "00-1", "Ruta 0000-", ""], text.is_operational_route) == [True, True, False, False, False]


def test_parse_date_formats(spark):
    got = values(spark, ["2024-12-31", "31/12/2024", "1-2-2024", "2024/3/5", "Enero 2024", "2024 (dic)", "31/02/2024", "x", "", None, "2024-01-05T10:00", "abril-2023"], dates.parse_date)
    # A day that does not exist falls back to the month named by the same digits.
    assert got == [date(2024, 12, 31), date(2024, 12, 31), date(2024, 2, 1), date(2024, 3, 5), date(2024, 1, 1), date(2024, 12, 1), date(2024, 2, 1),
                   None, None, None, date(2024, 1, 5), date(2023, 4, 1)]


def test_parse_year_and_month(spark):
    assert values(spark, ["2024", " año 2024 ", "1899", "20", ""], dates.parse_year) == [2024, 2024, None, None, None]
    assert values(spark, ["1", "12", "13", "Sept", "december", "x"], dates.parse_month) == [1, 12, None, 9, 12, None]


def test_week_label_uses_the_iso_year(spark):
    assert values(spark, ["2024-12-30", "2021-01-03"], lambda x: dates.week_of(x.cast("date"))) == ["2025-W01", "2020-W53"]


@pytest.mark.parametrize("rule, expected", [(numbers.pct_change, [0.0, 100.0, 0.0, 100.0, 50.0]), (numbers.pct_change_abs, [0.0, 100.0, 100.0, 100.0, -150.0])])
def test_percent_rules_differ_for_zero_and_negative_bases(spark, rule, expected):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 0.0), (2, -5.0, 0.0), (3, 20.0, 10.0), (4, -15.0, -10.0 if rule is numbers.pct_change else -6.0)], "i int, c double, p double")
    got = [r.y for r in df.select("i", rule("c", "p").alias("y")).orderBy("i").collect()]
    assert got == pytest.approx(expected)


def test_traffic_light_and_its_inverse(spark):
    df = spark.createDataFrame([(x,) for x in (44.0, 50.0, 61.0)], "v double")
    row = df.select(numbers.traffic_light("v", 60.0, 45.0).alias("inverse"), numbers.traffic_light("v", 45.0, 60.0).alias("plain")).collect()
    assert [(r.inverse, r.plain) for r in row] == [("green", "red"), ("yellow", "yellow"), ("red", "green")]
