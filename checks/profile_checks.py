"""Queries for the column profile and what follows from it."""

from pyspark.sql import functions as F

from checks.fixtures import Checks, table, with_fact
from ventara.operators import profile as ops

C = Checks()

FIELDS = (
    "date", "year", "month", "client_key", "client", "client_name", "invoice", "product_key", "product_name", "seller_key", "seller_name",
    "sales_scheme_name", "sales_force", "route_description", "family", "line", "brand", "business_unit", "supplier", "caliber", "channel", "amount",
    "quantity", "cost", "sign", "has_article_match", "flavor",
)
NUMERIC = {"year", "month", "amount", "quantity", "cost", "sign"}
# Role expected for each field, written down by hand.
ROLES = {
    "date": ("FECHA", None), "year": ("FECHA", "FECHA_AÑO"), "month": ("FECHA", "FECHA_MES"), "client_key": ("IDENTIFICADOR", "ID_CLIENTE"),
    "client": ("DIMENSIÓN", "DIM_CLIENTE"), "client_name": ("DIMENSIÓN", "DIM_CLIENTE"), "invoice": ("IDENTIFICADOR", "ID_COMPROBANTE"),
    "product_key": ("IDENTIFICADOR", "ID_PRODUCTO"), "product_name": ("DIMENSIÓN", "DIM_PRODUCTO"), "seller_key": ("IDENTIFICADOR", "ID_VENDEDOR"),
    "seller_name": ("DIMENSIÓN", "DIM_VENDEDOR"), "sales_scheme_name": ("DIMENSIÓN", "DIM_ESQUEMA_VENTAS"), "sales_force": ("DIMENSIÓN", "DIM_FUERZA"),
    "route_description": ("DIMENSIÓN", "DIM_RUTA"), "family": ("DIMENSIÓN", "DIM_FAMILIA"), "line": ("DIMENSIÓN", "DIM_LINEA"),
    "brand": ("DIMENSIÓN", None), "business_unit": ("DIMENSIÓN", None), "supplier": ("DIMENSIÓN", "DIM_PROVEEDOR"), "caliber": ("DIMENSIÓN", "DIM_CALIBRE"),
    "channel": ("DIMENSIÓN", "DIM_CANAL"), "amount": ("MÉTRICA", "MET_VENTA"), "quantity": ("MÉTRICA", "MET_CANTIDAD"),
    "cost": ("MÉTRICA", "MET_COSTO"), "sign": ("MÉTRICA", "MET_VENTA"), "has_article_match": ("DIMENSIÓN", None),
}


def _text(f):
    return "CAST(has_article_match AS VARCHAR)" if f == "has_article_match" else f"CAST({f} AS VARCHAR)"


def _profile_cte():
    parts = []
    for f, (role, sub) in ROLES.items():
        listed = role in ("DIMENSIÓN", "IDENTIFICADOR")
        sub_sql = f"'{sub}'" if sub else "CAST(NULL AS VARCHAR)"
        top = f"(SELECT string_agg(v || '=' || n, ',' ORDER BY n DESC, v) FROM (SELECT {_text(f)} AS v, count(*) AS n FROM fact WHERE {f} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"
        parts.append(f"""SELECT '{f}' AS field, '{role}' AS role, {sub_sql} AS subrole, count({f}) / CAST(count(*) AS DOUBLE) AS coverage,
          {f'count(DISTINCT {f})' if listed else 'CAST(NULL AS BIGINT)'} AS cardinality, {top if listed else 'CAST(NULL AS VARCHAR)'} AS top_values FROM fact""")
    return "profile AS (" + " UNION ALL ".join(parts) + ")"


def _profiled(fact):
    return ops.profile(fact.withColumn("flavor", F.lit(None).cast("string")), FIELDS)


@C.add("profile", with_fact("SELECT * FROM profile", _profile_cte()))
def profile(fact):
    text = F.array_join(F.transform("top_values", lambda x: F.concat_ws("=", x.value, x.n)), ",")
    return _profiled(fact).withColumn("top_values", text)


def _infer_sql():
    parts = []
    for f in ("period", "amount", "year", "month", "date", "fact_key", "channel", "cost", "line_no"):
        numeric = f in ("amount", "year", "month", "cost", "line_no")
        dated = f == "date"
        sub_metric = "'MET_COSTO'" if f == "cost" else "'MET_VENTA'"
        sub_dim = "'DIM_CANAL'" if f == "channel" else "NULL"
        if dated:
            parts.append(f"SELECT '{f}' AS field, 'FECHA' AS role, NULL AS subrole, count({f}) / CAST(count(*) AS DOUBLE) AS coverage FROM fact")
        elif numeric:
            parts.append(f"""SELECT '{f}', CASE WHEN count(DISTINCT {f}) <= 12 AND min({f}) >= 1 AND max({f}) <= 12 THEN 'FECHA'
              WHEN count(DISTINCT {f}) <= 30 AND min({f}) >= 1900 AND max({f}) <= 2100 THEN 'FECHA' ELSE 'MÉTRICA' END,
              CASE WHEN count(DISTINCT {f}) <= 12 AND min({f}) >= 1 AND max({f}) <= 12 THEN 'FECHA_MES'
              WHEN count(DISTINCT {f}) <= 30 AND min({f}) >= 1900 AND max({f}) <= 2100 THEN 'FECHA_AÑO' ELSE {sub_metric} END, count({f}) / CAST(count(*) AS DOUBLE) FROM fact""")
        else:
            parts.append(f"""SELECT '{f}' AS field, CASE WHEN count(DISTINCT {f}) / count({f}) > 0.8 THEN 'IDENTIFICADOR' ELSE 'DIMENSIÓN' END AS role,
              CASE WHEN count(DISTINCT {f}) / count({f}) > 0.8 THEN NULL ELSE {sub_dim} END AS subrole, count({f}) / CAST(count(*) AS DOUBLE) AS coverage FROM fact""")
    return " UNION ALL ".join(parts)


@C.add("role_inference", with_fact(_infer_sql()))
def role_inference(fact):
    return ops.infer_roles(fact, ["period", "amount", "year", "month", "date", "fact_key", "channel", "cost", "line_no"])


@C.add("profile_raw", """
WITH cells AS (
  SELECT 'Fecha comprobante' AS field, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS value FROM orders
  UNION ALL SELECT 'Cliente', CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END FROM orders
  UNION ALL SELECT 'Importe neto', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders
  UNION ALL SELECT 'Columna 4', CAST(year(o_orderdate) AS VARCHAR) FROM orders
  UNION ALL SELECT 'Columna 5', o_orderpriority FROM orders
  UNION ALL SELECT 'Columna 6', 'x' || CAST(o_orderkey AS VARCHAR) FROM orders),
n AS (SELECT field, value, count(*) AS n FROM cells WHERE value <> '' GROUP BY 1, 2)
SELECT c.field, r.role, r.subrole, c.coverage, CASE WHEN r.role IN ('DIMENSIÓN', 'IDENTIFICADOR') THEN c.cardinality END AS cardinality,
  CASE WHEN r.role IN ('DIMENSIÓN', 'IDENTIFICADOR') THEN t.top END AS top_values
FROM (SELECT field, CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM orders) AS coverage, count(*) AS cardinality FROM n GROUP BY field) c
JOIN (VALUES ('Fecha comprobante', 'FECHA', NULL), ('Cliente', 'DIMENSIÓN', 'DIM_CLIENTE'), ('Importe neto', 'MÉTRICA', 'MET_VENTA'),
  ('Columna 4', 'FECHA', 'FECHA_MES'), ('Columna 5', 'DIMENSIÓN', NULL), ('Columna 6', 'IDENTIFICADOR', NULL)) r(field, role, subrole) ON r.field = c.field
JOIN (SELECT field, string_agg(value || '=' || n, ',' ORDER BY n DESC, value) AS top FROM (
  SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 5) GROUP BY field) t ON t.field = c.field
""".replace("('Columna 4', 'FECHA', 'FECHA_MES')", "('Columna 4', 'FECHA', 'FECHA_AÑO')"), on_fact=False)
def profile_raw(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    headers = ["Fecha comprobante", "Cliente", "Importe neto", "Columna 4", "Columna 5", "Columna 6"]
    rows = orders.select(
        F.array(*[F.lit(h) for h in headers]).alias("headers"),
        F.array(
            F.col("o_orderdate").cast("date").cast("string"),
            F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.col("o_custkey").cast("string")),
            F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.year("o_orderdate").cast("string"), "o_orderpriority",
            F.concat(F.lit("x"), F.col("o_orderkey").cast("string")),
        ).alias("cells"),
    )
    text = F.array_join(F.transform("top_values", lambda x: F.concat_ws("=", x.value, x.n)), ",")
    return ops.profile_raw(rows).withColumn("top_values", text)


_BEST = """best AS (SELECT CASE WHEN role = 'FECHA' AND subrole IS NULL THEN 'FECHA' ELSE subrole END AS subrole, field, coverage, cardinality FROM profile
  WHERE role = 'FECHA' OR subrole IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY CASE WHEN role = 'FECHA' AND subrole IS NULL THEN 'FECHA' ELSE subrole END ORDER BY coverage DESC, field) = 1)"""


@C.add("subrole_fields", with_fact("SELECT * FROM best", _profile_cte(), _BEST))
def subrole_fields(fact):
    return ops.subrole_fields(_profiled(fact))


_NEEDS = """needs(analysis, need) AS (VALUES ('temporal_trend','FECHA'),('temporal_trend','MÉTRICA'),('dimension_ranking','DIMENSIÓN'),('dimension_ranking','MÉTRICA'),
  ('recurrence_churn','FECHA'),('recurrence_churn','DIM_CLIENTE'),('recurrence_churn','MET_VENTA'),('cross_sell_mix','DIM_CLIENTE'),('cross_sell_mix','DIM_FAMILIA'),
  ('seller_performance','DIM_VENDEDOR'),('seller_performance','MET_VENTA'),('geographic_coverage','DIM_RUTA'),('geographic_coverage','MET_VENTA'),
  ('margin_analysis','MET_COSTO'),('margin_analysis','MET_VENTA'),('sales_force_breakdown','DIM_FUERZA'),('sales_force_breakdown','MET_VENTA'),
  ('product_analysis','DIM_PRODUCTO'),('product_analysis','MET_VENTA'),('channel_analysis','DIM_CANAL'),('channel_analysis','MET_VENTA'))"""
_AVAILABLE = """available AS (SELECT analysis FROM needs n GROUP BY analysis
  HAVING bool_and(EXISTS (SELECT 1 FROM profile p WHERE p.role = n.need OR p.subrole = n.need)))"""


# Without the family and route columns, so that some analyses drop out.
SHORT = tuple(f for f in FIELDS if f not in ("route_description", "family"))
_SHORT = "short AS (SELECT * FROM profile WHERE field NOT IN ('route_description', 'family'))"


@C.add("available_analyses", with_fact("SELECT analysis FROM available", _profile_cte().replace("profile AS (", "whole AS (", 1),
                                       "profile AS (SELECT * FROM whole WHERE field NOT IN ('route_description', 'family'))", _NEEDS, _AVAILABLE))
def available_analyses(fact):
    return ops.available_analyses(ops.profile(fact.withColumn("flavor", F.lit(None).cast("string")), SHORT))


# Written out by hand, apart from the table that the operators use. Slots of the analyses with their subroles in order of
# preference; a slot with a fallback may stay without a field.
_WISHES = """wishes(analysis, slot, pref, subrole, optional) AS (VALUES
  ('temporal_trend', 'date', 0, 'FECHA', TRUE), ('temporal_trend', 'date', 1, 'FECHA_AÑO', TRUE), ('temporal_trend', 'date', 2, 'FECHA_MES', TRUE),
  ('temporal_trend', 'metric', 0, 'MET_VENTA', TRUE), ('temporal_trend', 'metric', 1, 'MET_CANTIDAD', TRUE),
  ('dimension_ranking', 'metric', 0, 'MET_VENTA', TRUE), ('dimension_ranking', 'metric', 1, 'MET_CANTIDAD', TRUE),
  ('recurrence_churn', 'date', 0, 'FECHA', FALSE), ('recurrence_churn', 'client', 0, 'DIM_CLIENTE', TRUE), ('recurrence_churn', 'client', 1, 'ID_CLIENTE', TRUE),
  ('recurrence_churn', 'metric', 0, 'MET_VENTA', TRUE), ('recurrence_churn', 'metric', 1, 'MET_CANTIDAD', TRUE),
  ('cross_sell_mix', 'client', 0, 'DIM_CLIENTE', TRUE), ('cross_sell_mix', 'client', 1, 'ID_CLIENTE', TRUE),
  ('cross_sell_mix', 'product', 0, 'DIM_FAMILIA', TRUE), ('cross_sell_mix', 'product', 1, 'DIM_LINEA', TRUE), ('cross_sell_mix', 'product', 2, 'DIM_PRODUCTO', TRUE),
  ('seller_performance', 'seller', 0, 'DIM_VENDEDOR', FALSE), ('seller_performance', 'metric', 0, 'MET_VENTA', TRUE), ('seller_performance', 'metric', 1, 'MET_CANTIDAD', TRUE),
  ('geographic_coverage', 'route', 0, 'DIM_RUTA', FALSE), ('geographic_coverage', 'metric', 0, 'MET_VENTA', TRUE), ('geographic_coverage', 'metric', 1, 'MET_CANTIDAD', TRUE),
  ('margin_analysis', 'revenue', 0, 'MET_VENTA', FALSE), ('margin_analysis', 'cost', 0, 'MET_COSTO', FALSE),
  ('sales_force_breakdown', 'sales_force', 0, 'DIM_FUERZA', FALSE), ('sales_force_breakdown', 'metric', 0, 'MET_VENTA', TRUE), ('sales_force_breakdown', 'metric', 1, 'MET_CANTIDAD', TRUE),
  ('product_analysis', 'product', 0, 'DIM_FAMILIA', TRUE), ('product_analysis', 'product', 1, 'DIM_LINEA', TRUE), ('product_analysis', 'product', 2, 'DIM_PRODUCTO', TRUE),
  ('product_analysis', 'metric', 0, 'MET_VENTA', TRUE), ('product_analysis', 'metric', 1, 'MET_CANTIDAD', TRUE),
  ('channel_analysis', 'channel', 0, 'DIM_CANAL', FALSE), ('channel_analysis', 'metric', 0, 'MET_VENTA', TRUE), ('channel_analysis', 'metric', 1, 'MET_CANTIDAD', TRUE))"""

# Domain, place of the domain, priority and place in the catalog.
_CATALOG = """catalog(analysis, domain, domain_rank, priority, catalog_rank) AS (VALUES ('temporal_trend', 'tiempo', 0, 1, 0), ('dimension_ranking', 'cartera', 1, 1, 1), ('recurrence_churn', 'cartera', 1, 1, 2),
  ('cross_sell_mix', 'producto', 3, 2, 3), ('seller_performance', 'territorio', 2, 1, 4), ('geographic_coverage', 'territorio', 2, 2, 5), ('margin_analysis', 'margen', 5, 1, 6),
  ('sales_force_breakdown', 'territorio', 2, 2, 7), ('product_analysis', 'producto', 3, 2, 8), ('channel_analysis', 'canal', 4, 2, 9))"""

# Dimensions by which an analysis can be split, in order.
_DIM_WISHES = """dim_lists(analysis, subroles) AS (VALUES
  ('temporal_trend', ['DIM_VENDEDOR', 'DIM_FUERZA', 'DIM_CANAL', 'DIM_FAMILIA', 'DIM_RUTA', 'DIM_CLIENTE']),
  ('dimension_ranking', ['DIM_CLIENTE', 'DIM_VENDEDOR', 'DIM_FUERZA', 'DIM_FAMILIA', 'DIM_RUTA', 'DIM_CANAL', 'DIM_PRODUCTO', 'DIM_PROVEEDOR', 'DIM_LINEA']),
  ('recurrence_churn', ['DIM_VENDEDOR', 'DIM_FUERZA', 'DIM_RUTA', 'DIM_CANAL']), ('cross_sell_mix', ['DIM_VENDEDOR', 'DIM_FUERZA', 'DIM_CANAL']),
  ('seller_performance', ['DIM_FUERZA', 'DIM_RUTA', 'DIM_CANAL']), ('geographic_coverage', ['DIM_FUERZA', 'DIM_VENDEDOR']),
  ('margin_analysis', ['DIM_CLIENTE', 'DIM_FAMILIA', 'DIM_PRODUCTO', 'DIM_VENDEDOR', 'DIM_CANAL']), ('sales_force_breakdown', ['DIM_VENDEDOR', 'DIM_RUTA', 'DIM_CANAL']),
  ('product_analysis', ['DIM_PROVEEDOR', 'DIM_LINEA', 'DIM_CANAL', 'DIM_CLIENTE']), ('channel_analysis', ['DIM_FAMILIA', 'DIM_VENDEDOR', 'DIM_FUERZA'])),
  dim_wishes AS (SELECT analysis, CAST(i - 1 AS BIGINT) AS pos, subroles[i] AS subrole FROM (SELECT analysis, subroles, unnest(range(1, len(subroles) + 1)) AS i FROM dim_lists))"""


_SLOTS = """slots AS (SELECT w.analysis, slot, arg_min(field, pref) FILTER (field IS NOT NULL) AS field, bool_or(optional) AS optional
    FROM wishes w LEFT JOIN best USING (subrole) GROUP BY 1, 2),
  runnable AS (SELECT analysis FROM available WHERE analysis NOT IN (SELECT analysis FROM slots WHERE field IS NULL AND NOT optional))"""


@C.add("task_slots", with_fact("SELECT analysis, slot, field FROM slots WHERE analysis IN (SELECT analysis FROM runnable)",
                               _profile_cte(), _BEST, _NEEDS, _AVAILABLE, _WISHES, _SLOTS))
def task_slots(fact):
    return ops.resolve_slots(_profiled(fact))


@C.add("tasks", with_fact(
    "SELECT r.analysis, domain, CAST(domain_rank AS BIGINT) AS domain_rank, CAST(priority AS BIGINT) AS priority, CAST(catalog_rank AS BIGINT) AS catalog_rank FROM runnable r JOIN catalog v ON v.analysis = r.analysis",
    _profile_cte(), _BEST, _NEEDS, _AVAILABLE, _WISHES, _SLOTS, _CATALOG))
def tasks(fact):
    return ops.tasks(_profiled(fact))


@C.add("combos", with_fact(
    """SELECT a.analysis, a.field AS dim_a, NULL AS dim_b, a.pos AS pos_a, CAST(-1 AS BIGINT) AS pos_b FROM d a
    UNION ALL SELECT a.analysis, a.field, b.field, a.pos, b.pos FROM d a JOIN d b ON a.analysis = b.analysis AND a.pos < b.pos AND a.analysis = 'dimension_ranking'""",
    _profile_cte(), _BEST, _NEEDS, _AVAILABLE, _WISHES, _SLOTS,
    _DIM_WISHES,
    "d AS (SELECT w.analysis, w.pos, b.field FROM dim_wishes w JOIN best b USING (subrole) JOIN runnable USING (analysis) WHERE b.coverage >= 0.10)"))
def combos(fact):
    return ops.combos(_profiled(fact))
