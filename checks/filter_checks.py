"""Queries for filters and facets."""

from checks.fixtures import CUR, PERIOD, Checks, with_fact
from ventara.operators import filters as ops

C = Checks()

SELECTION = {"channel": ["building", " MACHINERY "], "month": ["Mayo", 6], "family": ["economy", "Sin familia", "SMALL"]}

_VALUES = {
    "year": "CAST(year AS VARCHAR)", "month": "CAST(month AS VARCHAR)", "family": "family_l", "line": "line_l", "brand": "brand_l",
    "business_unit": "bu_l", "supplier": "supplier", "product_name": "product_name", "sales_scheme_name": "sales_scheme_name",
    "sales_force": "sales_force", "route_description": "route_l", "seller_name": "seller_name", "channel": "channel",
}
_TEST = {
    "channel": "lower(channel) IN ('building', 'machinery')", "month": "month IN (5, 6)",
    "family": "lower(family_l) IN ('economy', 'sin familia', 'small')",
}
_MONTH = """CASE value WHEN '1' THEN 'Enero' WHEN '2' THEN 'Febrero' WHEN '3' THEN 'Marzo' WHEN '4' THEN 'Abril' WHEN '5' THEN 'Mayo' WHEN '6' THEN 'Junio'
  WHEN '7' THEN 'Julio' WHEN '8' THEN 'Agosto' WHEN '9' THEN 'Septiembre' WHEN '10' THEN 'Octubre' WHEN '11' THEN 'Noviembre' WHEN '12' THEN 'Diciembre' END"""


def _facets(tests, fill):
    parts = []
    for field, value in _VALUES.items():
        others = " AND ".join([CUR] + [t for f, t in tests.items() if f != field])
        parts.append(f"SELECT '{field}' AS field, {value} AS value, count(*) AS rows FROM fact WHERE {others} GROUP BY 2")
    if fill:
        parts.append("SELECT 'year', '2001', 0")
        parts += [f"SELECT 'month', '{m}', 0" for m in (5, 6, 7)]
    return f"""SELECT field, value, CASE WHEN field = 'month' THEN {_MONTH} ELSE value END AS label, CAST(sum(rows) AS BIGINT) AS rows
    FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL GROUP BY 1, 2"""


@C.add("filter_apply", with_fact(
    f"SELECT period, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount FROM fact WHERE {' AND '.join(_TEST.values())} GROUP BY period"))
def filter_apply(fact):
    from pyspark.sql import functions as F

    rows = ops.apply_filters(fact, SELECTION)
    return rows.groupBy("period").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"))


@C.add("filter_empty_selection", with_fact("SELECT period, count(*) AS rows FROM fact WHERE FALSE GROUP BY period"))
def filter_empty_selection(fact):
    from pyspark.sql import functions as F

    return ops.apply_filters(fact, {"channel": []}).groupBy("period").agg(F.count("*").alias("rows"))


@C.add("faceted_filters", with_fact(_facets(_TEST, True)))
def faceted_filters(fact):
    return ops.facet_options(fact.filter(PERIOD.in_selected()), SELECTION, PERIOD)


@C.add("facet_options", with_fact(_facets({}, True)))
def facet_options(fact):
    return ops.facet_options(fact.filter(PERIOD.in_selected()), None, PERIOD)


@C.add("filter_usage", with_fact(
    f"""SELECT f AS field, CAST(s AS BIGINT) AS selected, available, nots = 0 AND available > 0 AS no_effect, available > 0 AND s / available >= 0.85 AS broad FROM (
      SELECT 'channel' AS f, 5 AS s, count(DISTINCT channel) AS available, count(DISTINCT channel) FILTER (lower(channel) NOT IN ('building','machinery','automobile','furniture','household')) AS nots FROM fact WHERE {CUR}
      UNION ALL SELECT 'month', 2, count(DISTINCT month), count(DISTINCT month) FILTER (month NOT IN (5, 6)) FROM fact WHERE {CUR}
      UNION ALL SELECT 'family', 6, count(DISTINCT family_l), count(DISTINCT family_l) FILTER (lower(family_l) NOT IN ('economy','small','large','medium','promo','standard')) FROM fact WHERE {CUR})"""))
def filter_usage(fact):
    chosen = {
        "channel": ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"], "month": [5, 6],
        "family": ["ECONOMY", "SMALL", "LARGE", "MEDIUM", "PROMO", "STANDARD"],
    }
    return ops.filter_usage(fact.filter(PERIOD.in_selected()), chosen, PERIOD)


@C.add("supplier_focus_filter", with_fact(
    "SELECT supplier, channel, count(*) AS rows FROM fact WHERE lower(channel) IN ('building', 'machinery') AND month IN (5, 6) "
    "AND lower(family_l) IN ('economy', 'sin familia', 'small') AND supplier = 'Supplier#000000007' GROUP BY ALL"))
def supplier_focus_filter(fact):
    from pyspark.sql import functions as F

    merged = ops.focus_supplier({**SELECTION, "supplier": ["Supplier#000000003", "supplier#000000007"]}, "Supplier#000000007")
    return ops.apply_filters(fact, merged).groupBy("supplier", "channel").agg(F.count("*").alias("rows"))
