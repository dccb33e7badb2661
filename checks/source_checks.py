"""Queries for file and ERP ingest and for the store, over raw rows derived from the test tables."""

from datetime import date
from uuid import uuid4

from pyspark.sql import functions as F

from checks import enrich_checks as masters
from checks.fixtures import Checks, table, with_fact
from ventara.functions.dates import serial_to_date
from ventara.functions.numbers import MEASURE
from ventara.operators import dispatch as runs
from ventara.plans import period
from ventara.plans.period import Period
from ventara.plans.schema import DATASET_FIELDS
from ventara.plans.session import checkpoint, checkpoint_dir
from ventara.sources import erp, mapping, normalise, store, workbook

C = Checks()


# --- files: raw rows with mixed formats ---------------------------------------------------------

_HEADERS = ("Fecha", "Año", "Mes", "Cod cliente", "Razón social", "Ruta", "Cod vendedor", "Vendedor", "Id esquema", "Esquema ventas", "SKU", "Artículo",
            "Factura", "Canal", "Importe", "Importe neto", "Importe final", "Impuestos internos", "Cantidad")
_MAPPING = {f: i for i, f in enumerate(DATASET_FIELDS["sales"])}


def _money(x, kind):
    english = F.format_number(x, 2)
    plain = F.replace(english, F.lit(","), F.lit(""))
    return (F.when(kind == 0, plain).when(kind == 1, F.translate(english, ".,", ",.")).when(kind == 2, english).otherwise(F.translate(plain, ".", ",")))


def raw_files(spark, sf_dir):
    """Lines as text cells: four number formats, five ways to write the day, blank and zero keys, bad amounts."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.col("o_orderdate")
    how, kind = F.col("l_orderkey") % 5, F.col("l_partkey") % 4
    months = F.array(*[F.lit(m) for m in ("Enero", "feb", "Marzo", "APRIL", "mayo", "june", "Julio", "ago", "Sept", "octubre", "nov", "Diciembre")])
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    text = lambda c: F.col(c).cast("string")
    cells = F.array(
        F.when(how == 0, F.date_format(day, "yyyy-MM-dd")).when(how == 1, F.date_format(day, "dd/MM/yyyy")).when(how == 2, F.concat(F.date_format(day, "d-M-yyyy")))
        .when(how == 3, F.concat_ws(" ", F.get(months, F.month(day) - 1), F.year(day).cast("string"))).otherwise(""),
        F.when(how == 4, F.concat(F.lit(" "), F.year(day).cast("string"))).otherwise(""), F.when(how == 4, F.get(months, F.month(day) - 1)).otherwise(""),
        F.when(F.col("o_custkey") % 19 == 0, "").when(F.col("o_custkey") % 23 == 0, "0").otherwise(F.concat(F.lit(" cli-"), text("o_custkey"), F.lit(" "))),
        F.when(F.col("o_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit("Cliente "), text("o_custkey"))), F.lit(" Ruta 1 "), text("l_suppkey"), F.lit("Vendedor"),
        F.lit(""), F.lit(""), F.concat(F.lit("p"), text("l_partkey")), F.lit("Producto"),
        F.when(F.col("l_orderkey") % 6 == 0, "").otherwise(text("l_orderkey")), F.lit("Canal"),
        F.when(F.col("l_partkey") % 17 == 0, "n/a").otherwise(_money(price, kind)),
        F.when(F.col("l_partkey") % 5 == 0, "").otherwise(_money(price, kind)), F.lit(""),
        F.when(F.col("l_partkey") % 2 == 0, "1,25").otherwise(""), F.col("l_quantity").cast("int").cast("string"),
    )
    return lines.select(F.concat(F.lit("ventas_"), F.year(day).cast("string"), F.lit(".xlsx")).alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), cells.alias("cells"))


_LINES = """lines AS (SELECT *, CAST(o_orderdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  good AS (SELECT *, CASE WHEN l_orderkey % 5 IN (3, 4) THEN date_trunc('month', day) ELSE day END AS d, 'CLI-' || o_custkey AS ck, 'ventas_' || year(day) || '.xlsx' AS src FROM lines
    WHERE o_custkey % 19 <> 0 AND o_custkey % 23 <> 0 AND l_partkey % 17 <> 0)"""

_NORM_SQL = f"""WITH {_LINES} SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS date, year(d) AS year, month(d) AS month, ck AS client_key,
    CASE WHEN o_custkey % 3 = 0 THEN ck ELSE 'Cliente ' || o_custkey END AS client_name, 'Ruta 1' AS route_description,
    CASE WHEN l_suppkey = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS seller_key, 'Vendedor' AS seller_name, '' AS sales_scheme_key, '' AS sales_scheme_name,
    'P' || l_partkey AS product_key, 'Producto' AS product_name,
    CASE WHEN l_orderkey % 6 = 0 THEN src || '-' || ck || '-' || CAST(CAST(d AS DATE) AS VARCHAR) || '-' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) ELSE CAST(l_orderkey AS VARCHAR) END AS invoice,
    'Canal' AS channel, CAST(price AS DOUBLE) AS amount, CAST(price AS DOUBLE) AS amount_net, CAST(price AS DOUBLE) AS amount_final,
    CASE WHEN l_partkey % 2 = 0 THEN 1.25::DOUBLE ELSE 0.0::DOUBLE END AS internal_taxes, CAST(price + CASE WHEN l_partkey % 2 = 0 THEN 1.25 ELSE 0 END AS DOUBLE) AS amount_net_internal,
    l_quantity AS quantity, src AS source FROM good"""


@C.add("normalize_sales", _NORM_SQL, on_fact=False)
def normalize_sales(spark, sf_dir):
    return normalise.normalise_sales(raw_files(spark, sf_dir), _MAPPING)


@C.add("source_counts", f"""WITH {_LINES} SELECT a.source, rows_read, coalesce(rows_valid, 0) AS rows_valid FROM
    (SELECT 'ventas_' || year(day) || '.xlsx' AS source, count(*) AS rows_read FROM lines GROUP BY 1) a LEFT JOIN (SELECT src AS source, count(*) AS rows_valid FROM good GROUP BY 1) b USING (source)""", on_fact=False)
def source_counts(spark, sf_dir):
    raw = raw_files(spark, sf_dir)
    early = raw.filter(F.col("file") < "ventas_1999")
    late = raw.filter(F.col("file") >= "ventas_1999")
    valid = normalise.union_sources([normalise.normalise_sales(part, _MAPPING) for part in (early, late)])
    return normalise.source_counts(raw, valid)


_PART_CELLS = ("p_partkey", "p_name", "p_type", "p_brand", "p_size")


@C.add("normalize_articles", """SELECT 'P' || p_partkey AS product_key, p_name AS product_name, p_type AS family, '' AS line, p_brand AS brand, '' AS business_unit, '' AS segment, '' AS division, '' AS supplier,
    '' AS flavor, '' AS uxb, CAST(p_size AS VARCHAR) AS caliber, p_partkey AS load_seq FROM part WHERE p_partkey % 10 <> 0""", on_fact=False)
def normalize_articles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.concat(F.lit(" p"), F.col("p_partkey").cast("string")))
    rows = part.select(F.col("p_partkey").alias("row_no"), F.array(key, F.concat("p_name", F.lit(" ")), "p_type", "p_brand", F.col("p_size").cast("string")).alias("cells"))
    return normalise.normalise_articles(rows, {"product_key": 0, "product_name": 1, "family": 2, "brand": 3, "caliber": 4})


@C.add("normalize_masters", """SELECT 'routes' AS kind, r_name AS sales_force, n_name AS seller_name, 'Ruta ' || c_custkey AS route_description, CAST(NULL AS VARCHAR) AS seller_key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 4 <> 0
    UNION ALL SELECT 'sellers', '', CASE WHEN c_custkey % 4 = 0 THEN 'K' || c_custkey ELSE n_name END, '', 'K' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey""", on_fact=False)
def normalize_masters(spark, sf_dir):
    base = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("n_name"))
    rows = base.select(F.col("c_custkey").alias("row_no"), F.array("r_name", name, F.concat(F.lit("Ruta "), F.col("c_custkey")), F.concat(F.lit("k"), F.col("c_custkey"))).alias("cells"))
    routes = normalise.normalise_routes(rows, {"sales_force": 0, "seller_name": 1, "route_description": 2})
    sellers = normalise.normalise_sellers(rows, {"seller_key": 3, "seller_name": 1})
    shape = ["sales_force", "seller_name", "route_description"]
    return routes.select(F.lit("routes").alias("kind"), *shape, F.lit(None).cast("string").alias("seller_key")).unionByName(sellers.select(F.lit("sellers").alias("kind"), *shape, "seller_key"))


def sheets(spark, sf_dir):
    """One sheet per client: a title, a header whose columns depend on the client, and its orders."""
    orders = table(spark, sf_dir, "orders")
    from pyspark.sql import Window

    file = F.concat(F.lit("cliente_"), F.col("o_custkey"), F.lit(".xlsx"))
    numbered = orders.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    data = numbered.select(file.alias("file"), (F.col("n") + 1).cast("long").alias("row_no"), F.array(
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("")).alias("cells"))
    kind = F.col("o_custkey") % 3
    head = orders.select("o_custkey").distinct().select(file.alias("file"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("row_no"), F.array(F.lit("Informe"), F.lit(""), F.lit(""), F.lit("")).alias("cells")),
        F.struct(F.lit(1).cast("long").alias("row_no"), F.when(kind == 0, F.array(F.lit("Fecha"), F.lit("Comprobante"), F.lit("Importe"), F.lit("")))
                 .when(kind == 1, F.array(F.lit(" Date "), F.lit("Factura"), F.lit("Importe neto"), F.lit("Total final"))).otherwise(F.array(F.lit("Día"), F.lit("Ticket"), F.lit("Ventas"), F.lit("Ventas"))).alias("cells")),
    )).alias("h")).select("file", "h.*")
    return head.unionByName(data).select("file", F.lit("Hoja1").alias("sheet"), "row_no", "cells")


_HEADS = """heads AS (SELECT DISTINCT 'cliente_' || o_custkey || '.xlsx' AS file, o_custkey % 3 AS k FROM orders)"""


@C.add("header_rows", f"""WITH {_HEADS} SELECT file, 'Hoja1' AS sheet, CAST(1 AS BIGINT) AS header_row,
    CASE k WHEN 0 THEN 'Fecha|Comprobante|Importe|Columna 4' WHEN 1 THEN 'Date|Factura|Importe neto|Total final' ELSE 'Día|Ticket|Ventas|Ventas' END AS headers FROM heads""", on_fact=False)
def header_rows(spark, sf_dir):
    return workbook.header_rows(sheets(spark, sf_dir)).withColumn("headers", F.array_join("headers", "|"))


@C.add("data_rows", """SELECT 'cliente_' || o_custkey || '.xlsx' AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no,
    CAST(o_orderkey AS VARCHAR) AS invoice FROM orders""", on_fact=False)
def data_rows(spark, sf_dir):
    return workbook.data_rows(sheets(spark, sf_dir)).select("file", "row_no", F.get("cells", 1).alias("invoice"))


# Expected best columns per kind of header, written down by hand: (kind, field, column, header, score).
_HITS = [
    (0, "date", 0, "Fecha", 8), (0, "invoice", 1, "Comprobante", 11), (0, "amount", 2, "Importe", 7),
    (1, "date", 0, "Date", 4), (1, "invoice", 1, "Factura", 7), (1, "amount", 2, "Importe neto", 11),
    (1, "amount_net", 2, "Importe neto", 16), (1, "amount_final", 3, "Total final", 16),
    (2, "date", 0, "Día", 3), (2, "invoice", 1, "Ticket", 6), (2, "amount", 2, "Ventas", 5),
]


@C.add("mapping_suggestions", f"""WITH {_HEADS} SELECT file, 'Hoja1' AS sheet, field, CAST(col AS BIGINT) AS "column", header, CAST(score AS BIGINT) AS score FROM heads
    JOIN (VALUES {', '.join(f"({k}, '{f}', {c}, '{h}', {s})" for k, f, c, h, s in _HITS)}) v(k, field, col, header, score) ON v.k = heads.k""", on_fact=False)
def mapping_suggestions(spark, sf_dir):
    return mapping.suggest_mapping(workbook.header_rows(sheets(spark, sf_dir)))


# --- ERP payloads -------------------------------------------------------------------------------


def erp_lines_raw(spark, sf_dir):
    """Sale lines with every field as text, the way the declared schema reads the payload."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    k = F.col("l_orderkey")
    text = lambda c: F.col(c).cast("string")
    payload = (
        F.when(F.col("l_partkey") % 29 == 0, "SI").otherwise("NO").alias("anulado"), F.when(k % 2 == 0, day).otherwise("").alias("fechaComprobate"), day.alias("fechaPedido"),
        F.when(k % 3 == 0, _money(price, F.lit(1))).alias("subtotalFinal"), F.when(k % 3 == 1, price).alias("totalNeto"), F.when(k % 3 == 2, price).alias("subtotalBruto"),
        F.when(F.col("l_partkey") % 2 == 0, "2,50").alias("impuestoInterno"),
        F.when(F.col("o_custkey") % 21 == 0, "0").otherwise(F.concat(text("o_custkey"), F.lit(".0"))).alias("idCliente"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Cliente "), text("o_custkey"))).alias("nombreCliente"),
        text("l_suppkey").alias("idVendedor"), F.lit(" Vend ").alias("dsVendedor"), F.when(k % 4 == 0, "Ruta C").alias("desRuta"), F.lit("Planilla 1").alias("planillaCarga"),
        F.when(F.col("l_partkey") % 3 == 0, text("l_partkey")).otherwise("").alias("idArticuloEstadistico"), F.concat(F.lit("A"), text("l_partkey")).alias("idArticulo"), F.lit("Art").alias("dsArticulo"),
        F.when(k % 2 == 0, "Sub").alias("dsSubcanalMKT"), F.lit("Seg").alias("dsSegmentoMkt"), F.col("l_quantity").alias("unimedtotal"),
        F.when(k % 5 != 0, text("l_orderkey")).alias("idDocumento"), F.when(k % 5 != 0, "A").alias("letra"), F.when(k % 5 != 0, F.col("l_linenumber")).alias("nrodoc"),
        F.when(k % 10 == 0, text("l_orderkey")).alias("idPedido"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("idLinea"), F.lit("7,00").alias("idFuerzaVentas"), F.lit("Fuerza 7").alias("dsFuerzaVentas"),
    )
    raw = lines.select(*payload)
    return raw.select(*[(F.col(f) if f in raw.columns else F.lit(None)).cast("string").alias(f) for f in erp.SALE_FIELDS])


@C.add("erp_lines", """SELECT CAST(NULL AS VARCHAR) AS row_version, CASE WHEN l_orderkey % 5 <> 0 AND l_orderkey <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS document_key,
    CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS VARCHAR) END AS line_key, CASE WHEN l_linenumber > 1 THEN 'line' ELSE 'summary' END AS detail_level,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, year(o_orderdate) AS year, month(o_orderdate) AS month, CAST(o_custkey AS VARCHAR) AS client_key,
    CASE WHEN o_custkey % 2 = 0 THEN 'Cliente ' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS client_name, CASE WHEN l_orderkey % 4 = 0 THEN 'Ruta C' ELSE 'Planilla 1' END AS route_description,
    CASE WHEN l_orderkey % 4 = 0 THEN 'Ruta C' ELSE '' END AS commercial_route, 'Planilla 1' AS route_sheet, CASE WHEN l_suppkey <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS seller_key, 'Vend' AS seller_name,
    '7' AS sales_scheme_key, 'Fuerza 7' AS sales_scheme_name, '7' AS sales_force_key, 'Fuerza 7' AS sales_force,
    CASE WHEN l_partkey % 3 = 0 AND l_partkey <> 0 THEN CAST(l_partkey AS VARCHAR) ELSE 'A' || l_partkey END AS product_key, 'Art' AS product_name, 'Seg' AS segment_name, '' AS channel_name,
    CASE WHEN l_orderkey % 2 = 0 THEN 'Sub' ELSE '' END AS subchannel_name,
    CASE WHEN l_orderkey % 5 <> 0 THEN l_orderkey || '-A-' || l_linenumber WHEN l_orderkey % 10 = 0 AND l_orderkey <> 0 THEN CAST(l_orderkey AS VARCHAR) ELSE 'ERP' END AS invoice,
    CASE WHEN l_orderkey % 2 = 0 THEN 'Sub' ELSE 'Seg' END AS channel, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount_net,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount_final, CASE WHEN l_partkey % 2 = 0 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS internal_taxes,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + CASE WHEN l_partkey % 2 = 0 THEN 2.5 ELSE 0 END AS DOUBLE) AS amount_net_internal, l_quantity AS quantity, 'ERP' AS source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 29 <> 0 AND o_custkey % 21 <> 0""", on_fact=False)
def erp_lines(spark, sf_dir):
    return erp.erp_sales(erp_lines_raw(spark, sf_dir))


@C.add("article_groups", """SELECT product_key, CAST(NULL AS VARCHAR) AS row_version, name AS product_name, p_type AS family, CASE WHEN v = 1 THEN 'Linea B' ELSE 'Linea A' END AS line, 'Prov ' || p_size AS supplier, CAST(NULL AS VARCHAR) AS flavor,
    CASE WHEN p_partkey % 3 = 0 THEN 'MS ' || p_brand ELSE p_brand END AS brand, CAST(NULL AS VARCHAR) AS business_unit, CAST(NULL AS VARCHAR) AS segment, CAST(NULL AS VARCHAR) AS division, CAST(NULL AS VARCHAR) AS generic,
    CASE WHEN p_partkey % 3 = 0 THEN 'MS ' || p_brand END AS mark_flavor, CAST(NULL AS VARCHAR) AS caliber, CASE WHEN p_partkey % 2 = 0 THEN '12' END AS uxb, p_partkey * 2 + v AS load_seq
  FROM (SELECT *, 'A' || p_partkey AS product_key, CASE WHEN v = 1 THEN p_name || ' v2' ELSE p_name END AS name FROM part, (VALUES (0), (1)) t(v) WHERE NOT (v = 1 AND p_partkey % 4 <> 0) AND NOT (v = 0 AND p_partkey % 7 = 0))
  QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY v DESC) = 1""", on_fact=False)
def article_groups(spark, sf_dir):
    """Every fourth product comes twice, every seventh is cancelled in its first version."""
    part = table(spark, sf_dir, "part").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).filter((F.col("v") == 0) | (F.col("p_partkey") % 4 == 0))
    group = lambda k, d, v: F.struct(F.lit(k).alias("idFormaAgrupar"), F.lit(d).alias("desFormaAgrupar"), v.alias("desAgrupacion"))
    brand = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("MS "), "p_brand")).otherwise(F.col("p_brand"))
    groups = F.array(
        group("familia", "x", F.lit("vieja")), group("FAMILIA", "x", F.col("p_type")), group("", "linea", F.when(F.col("v") == 1, " Linea B ").otherwise("Linea A")),
        group("LINPRODU", "x", F.lit(" ")), group("PROVEEDOR", "x", F.concat(F.lit("Prov "), F.col("p_size"))),
        F.struct(F.when(F.col("p_partkey") % 3 == 0, "MARCASAB").otherwise("MARCA").alias("idFormaAgrupar"), F.lit("x").alias("desFormaAgrupar"), brand.alias("desAgrupacion")),
    )
    payload = F.to_json(F.struct(
        ((F.col("v") == 0) & (F.col("p_partkey") % 7 == 0)).alias("anulado"), F.concat(F.lit("A"), F.col("p_partkey")).alias("idArticulo"), F.when(F.col("v") == 1, F.concat("p_name", F.lit(" v2"))).otherwise(F.col("p_name")).alias("desArticulo"),
        F.when(F.col("p_partkey") % 2 == 0, 12).alias("unidadesBulto"), groups.alias("eAgrupaciones")))
    rows = part.select(F.from_json(payload, erp.ARTICLE_SCHEMA).alias("r"), (F.col("p_partkey") * 2 + F.col("v")).alias("load_seq")).select("r.*", "load_seq")
    return erp.erp_articles(rows)


@C.add("staff_dedupe", """SELECT rv AS row_version, CASE WHEN n_nationkey <> 0 THEN CAST(n_nationkey AS VARCHAR) END AS seller_key, name AS seller_name, '3' AS sales_scheme_key, force AS sales_scheme_name, '3' AS sales_force_key, force AS sales_force, 'ERP' AS source,
    CAST(n_regionkey + 1 AS VARCHAR) AS branch_key, 'Sucursal' AS branch_name, role, '' AS sale_type, CAST(NULL AS VARCHAR) AS supervisor_key, '' AS supervisor_name FROM (
    SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 'VENDEDOR' ELSE 'SUPERVISOR' END AS role, CASE WHEN s_suppkey % 3 = 0 THEN 'Fuerza' ELSE '' END AS force,
      CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS rv, CASE WHEN n_nationkey = 0 THEN 'Sin Clave' ELSE s_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY role = 'VENDEDOR' DESC, force <> '' DESC, rv IS NOT NULL DESC, name DESC, s_suppkey DESC) = 1""", on_fact=False)
def staff_dedupe(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = base.select(
        F.col("n_nationkey").cast("string").alias("idPersonal"), F.when(F.col("n_nationkey") == 0, "Sin Clave").otherwise(F.col("s_name")).alias("desPersonal"), F.lit("3").alias("idFuerzaVentas"),
        F.when(F.col("s_suppkey") % 3 == 0, "Fuerza").otherwise("").alias("desFuerzaVentas"), (F.col("n_regionkey") + 1).cast("string").alias("idSucursal"), F.lit("Sucursal").alias("desSucursal"),
        F.when(F.col("s_suppkey") % 2 == 0, "VENDEDOR").otherwise("SUPERVISOR").alias("cargo"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey").cast("string")).alias("rowVersion"), F.col("s_suppkey").alias("load_seq"))
    return erp.erp_staff(rows)


def erp_routes_raw(spark, sf_dir):
    """One route per segment and nation, repeated per block of 200 clients with other validity dates."""
    clients = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("block", F.floor(F.col("c_custkey") / 200))
    grouped = clients.groupBy("n_nationkey", "n_name", "n_regionkey", "c_mktsegment", "block").agg(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("idCliente"))).alias("eClientesRutas"))
    return grouped.select(
        F.substring("c_mktsegment", 1, 3).alias("idRuta"), F.concat("n_name", F.lit(" "), "c_mktsegment").alias("desRuta"),
        F.when(F.col("block") % 4 == 0, None).otherwise("2000-01-01").alias("fechaDesde"), F.when(F.col("block") % 3 == 0, "2001-01-01").otherwise("2005-12-31T00:00:00").alias("fechaHasta"),
        (F.col("block") % 5 == 0).alias("anulado"), F.col("n_nationkey").cast("string").alias("idPersonal"), F.col("n_name").alias("desPersonal"), F.lit("1").alias("idFuerzaVentas"), F.lit("F1").alias("desFuerzaVentas"),
        (F.col("n_regionkey") + 1).cast("string").alias("idSucursal"), F.lit("S").alias("desSucursal"), F.lit(None).cast("string").alias("desModoAtencion"), F.lit("LU").alias("diasVisita"), F.lit("MA").alias("diasEntrega"),
        "eClientesRutas", F.col("block").alias("load_seq"))


@C.add("route_dedupe", """WITH b AS (SELECT n_nationkey, n_name, n_regionkey, c_mktsegment, CAST(floor(c_custkey / 200) AS BIGINT) AS block, count(*) AS cc FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    r AS (SELECT *, CASE WHEN block % 4 <> 0 THEN '2000-01-01' END AS vf, CASE WHEN block % 3 = 0 THEN '2001-01-01' ELSE '2005-12-31' END AS vt, block % 4 <> 0 AND block % 3 <> 0 AND block % 5 <> 0 AS act FROM b),
    best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY n_nationkey, c_mktsegment ORDER BY act DESC, vt DESC, coalesce(vf, '') DESC, cc DESC, block DESC) = 1),
    l AS (SELECT c_nationkey, c_mktsegment, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FILTER (c_custkey <> 0), '') AS ck FROM customer GROUP BY 1, 2)
  SELECT substr(best.c_mktsegment, 1, 3) AS route_key, n_name || ' ' || best.c_mktsegment AS route_description, CASE WHEN n_nationkey <> 0 THEN CAST(n_nationkey AS VARCHAR) END AS seller_key, n_name AS seller_name,
    '1' AS sales_scheme_key, 'F1' AS sales_scheme_name, '1' AS sales_force_key, 'F1' AS sales_force, CAST(n_regionkey + 1 AS VARCHAR) AS branch_key, 'S' AS branch_name, '' AS mode, 'LU' AS visit_days, 'MA' AS delivery_days,
    vf AS valid_from, vt AS valid_to, cc AS client_count, act AS is_active, ck AS client_keys FROM best JOIN l ON l.c_nationkey = n_nationkey AND l.c_mktsegment = best.c_mktsegment""", on_fact=False)
def route_dedupe(spark, sf_dir):
    return erp.erp_routes(erp_routes_raw(spark, sf_dir), date(2002, 6, 1)).withColumn("client_keys", F.array_join("client_keys", ","))


@C.add("marketing_flatten", """SELECT 'R' || r_regionkey AS marketing_key, 'R' || r_regionkey AS segment_key, r_name AS segment_name, NULL AS channel_key, '' AS channel_name, NULL AS subchannel_key, '' AS subchannel_name FROM region WHERE r_regionkey = 4
  UNION ALL SELECT 'N' || n_nationkey, 'R' || r_regionkey, r_name, 'N' || n_nationkey, n_name, NULL, '' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 4 AND n_nationkey % 3 = 0
  UNION ALL SELECT k, 'R' || r_regionkey, r_name, 'N' || n_nationkey, n_name, k, 'Sub ' || s_name FROM (SELECT *, 'S' || (s_suppkey // 2) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE r_regionkey <> 4 AND n_nationkey % 3 <> 0) QUALIFY row_number() OVER (PARTITION BY k ORDER BY r_regionkey DESC, n_nationkey DESC, s_suppkey DESC) = 1""", on_fact=False)
def marketing_flatten(spark, sf_dir):
    """Regions, nations and suppliers as segments, channels and subchannels; some levels are missing."""
    nation = table(spark, sf_dir, "nation")
    subs = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: F.struct(
        F.concat(F.lit("S"), F.floor(s.s_suppkey / 2)).alias("idSubcanalMkt"), F.concat(F.lit("Sub "), s.s_name).alias("desSubcanalMkt"))).alias("subs"))
    channels = nation.join(subs, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_regionkey", F.struct(
        F.col("n_nationkey").alias("o"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("idCanalMkt"), F.col("n_name").alias("desCanalMkt"), F.when(F.col("n_nationkey") % 3 != 0, F.col("subs")).alias("SubCanalesMkt")).alias("c"))
    lists = channels.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: F.struct(c.idCanalMkt.alias("idCanalMkt"), c.desCanalMkt.alias("desCanalMkt"), c.SubCanalesMkt.alias("SubCanalesMkt"))).alias("CanalesMkt"))
    rows = table(spark, sf_dir, "region").join(lists, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        F.concat(F.lit("R"), F.col("r_regionkey")).alias("idSegmentoMkt"), F.col("r_name").alias("desSegmentoMkt"), F.when(F.col("r_regionkey") != 4, F.col("CanalesMkt")).alias("CanalesMkt"), F.col("r_regionkey").alias("load_seq"))
    return erp.erp_marketing(rows)


def _sequenced(fact):
    return fact.withColumn("load_seq", F.struct("date", "invoice", "line_no", "product_key", "amount"))


def _last(attr, key):
    return f"""(SELECT k, {attr} FROM (SELECT {key} AS k, *, row_number() OVER (PARTITION BY {key} ORDER BY date DESC, invoice DESC, line_no DESC, product_key DESC, amount DESC) AS rn
      FROM fact WHERE {attr} IS NOT NULL) WHERE rn = 1)"""


@C.add("derived_sellers", with_fact(
    f"""SELECT k AS seller_key, seller_name, route_description, CAST(NULL AS VARCHAR) AS sales_scheme_key, sales_scheme_name, sales_force FROM {_last('seller_name', 'seller_key')} a
    LEFT JOIN {_last('route_description', 'seller_key')} b USING (k) LEFT JOIN {_last('sales_scheme_name', 'seller_key')} c USING (k) LEFT JOIN {_last('sales_force', 'seller_key')} d USING (k)"""))
def derived_sellers(fact):
    return erp.derived_sellers(_sequenced(fact).withColumn("sales_scheme_key", F.lit(None).cast("string")))


_RKEY = "lower(coalesce(route_description, seller_name))"


@C.add("derived_routes", with_fact(
    f"""SELECT sales_force, seller_name, coalesce(route_description, seller_name) AS route_description, CAST(NULL AS VARCHAR) AS sales_scheme_key, sales_scheme_name FROM {_last('seller_name', _RKEY)} a
    LEFT JOIN {_last('route_description', _RKEY)} b USING (k) LEFT JOIN {_last('sales_scheme_name', _RKEY)} c USING (k) LEFT JOIN {_last('sales_force', _RKEY)} d USING (k)"""))
def derived_routes(fact):
    return erp.derived_routes(_sequenced(fact).withColumn("sales_scheme_key", F.lit(None).cast("string")))


# --- store --------------------------------------------------------------------------------------

_SUMS = ", ".join(f"CAST(sum({m}) AS DOUBLE) AS {m}" for m in ("amount", "amount_net", "amount_final", "internal_taxes", "amount_net_internal", "quantity"))


@C.add("compaction", with_fact(
    f"""SELECT CAST(date AS VARCHAR) AS date, invoice, client_key, product_key, seller_key, '' AS sales_scheme_key, coalesce(route_description, '') AS route_description, channel, max(client_name) AS client_name,
      max(seller_name) AS seller_name, max(sales_scheme_name) AS sales_scheme_name, max(sales_force) AS sales_force, max(product_name) AS product_name, {_SUMS}, year(date) AS year, month(date) AS month
    FROM fact GROUP BY date, invoice, client_key, product_key, seller_key, route_description, channel"""))
def compaction(fact):
    return store.compact(fact)


@C.add("compaction_lines", with_fact(
    f"""SELECT line_id, CAST(date AS VARCHAR) AS date, count(*) AS lines, {_SUMS} FROM (
      SELECT *, concat_ws('|', CAST(date AS VARCHAR), client_key, invoice, CAST(line_no AS VARCHAR), product_key) AS line_id FROM fact) GROUP BY line_id, date""".replace("count(*) AS lines, ", "")))
def compaction_lines(fact):
    rows = store.compact_lines(fact.withColumn("line_key", F.col("line_no").cast("string")))
    return rows.select("line_id", "date", *store.MEASURES)


_R0, _R1 = date(2001, 5, 10), date(2001, 6, 20)


def _on_store(spark, build):
    """What `build(path)` finds in a store of its own: kept as a checkpoint, and the store's folder goes."""
    path = f"{checkpoint_dir(spark)}/store-{uuid4().hex}"
    try:
        return checkpoint(build(path))
    finally:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _detail(fact):
    """The fact's lines as they come in: with a line key, and without what the store derives."""
    return fact.select("date", "client_key", "client_name", "invoice", F.col("line_no").cast("string").alias("line_key"), "product_key", "seller_key", "channel", "has_article_match", *store.MEASURES)


_S0, _S1 = date(1990, 1, 1), date(2004, 12, 31)


# Some line ids occur twice in the test tables; the store keeps one line of each.
_OWN = """own AS (SELECT *, concat_ws('|', CAST(date AS VARCHAR), client_key, invoice, CAST(line_no AS VARCHAR), product_key) AS line_id FROM fact)"""


@C.add("range_replace", with_fact(
    """SELECT period, count(DISTINCT line_id) AS rows, CAST(sum(amount) AS DOUBLE) AS amount FROM (
      SELECT period, line_id, amount FROM own WHERE date NOT BETWEEN DATE '2001-05-10' AND DATE '2001-06-20'
      UNION ALL SELECT period, line_id, amount * 2 FROM own WHERE date BETWEEN DATE '2001-05-10' AND DATE '2001-06-20' AND channel <> 'BUILDING') GROUP BY period""", _OWN))
def range_replace(fact):
    """A store of all lines, a range of which is then replaced and published in one step."""
    spark, rows = fact.sparkSession, _detail(fact)
    fresh = rows.filter(F.col("channel") != "BUILDING").withColumn("amount", F.col("amount") * 2)

    def build(path):
        store.sync_range(spark, path, rows, _S0, _S1, full_detail=True)
        store.sync_range(spark, path, fresh, _R0, _R1, full_detail=True)
        found = store.read_sales(spark, path)
        return found.groupBy(F.date_format("date", "yyyy-MM").alias("period")).agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"))

    return _on_store(spark, build)


# A batch for the range: a third of its clients is absent, every second line comes twice (half of the amount each time), and clients of a new prefix.
_BATCH = """batch AS (SELECT date, client_key, channel, period, concat_ws('|', CAST(date AS VARCHAR), client_key, invoice, CAST(line_no AS VARCHAR), product_key) AS line_id, CASE WHEN line_no % 2 = 0 THEN amount ELSE amount * 3 END AS amount
    FROM fact WHERE date BETWEEN DATE '2001-05-10' AND DATE '2001-06-20' AND CAST(client_key AS INT) % 3 <> 0
  UNION ALL SELECT date, 'N' || client_key, channel, period, concat_ws('|', CAST(date AS VARCHAR), 'N' || client_key, invoice, CAST(line_no AS VARCHAR), product_key), amount
    FROM fact WHERE date BETWEEN DATE '2001-05-10' AND DATE '2001-06-20' AND CAST(client_key AS INT) % 5 = 0)"""


def _batch(rows):
    """The lines of the batch in one pass: each line of the range becomes none to three of them."""
    inside = rows.filter(F.col("date").between(F.lit(_R0), F.lit(_R1)))
    known, more = F.col("client_key").cast("int") % 3 != 0, F.col("client_key").cast("int") % 5 == 0
    even = F.col("line_key").cast("int") % 2 == 0
    line = lambda amount, prefix="": F.struct(F.concat(F.lit(prefix), "client_key").alias("client_key"), amount.cast(MEASURE).alias("amount"))
    amount = F.col("amount")
    half = line(amount / 2)
    lines = F.array(F.when(known & even, half), F.when(known & even, half), F.when(known & ~even, line(amount * 3)), F.when(more, line(amount, "N")))
    return inside.withColumn("b", F.explode(F.filter(lines, lambda x: x.isNotNull()))).withColumns({"client_key": F.col("b.client_key"), "amount": F.col("b.amount")}).drop("b")


@C.add("line_merge", with_fact(
    """SELECT period, count(DISTINCT line_id) AS lines, count(DISTINCT line_id) FILTER (client_key LIKE 'N%') AS new_lines, CAST(sum(amount) AS DOUBLE) AS amount FROM (
      SELECT period, line_id, client_key, amount FROM own WHERE date NOT BETWEEN DATE '2001-05-10' AND DATE '2001-06-20' UNION ALL SELECT period, line_id, client_key, amount FROM batch) GROUP BY period""", _OWN, _BATCH))
def line_merge(fact):
    """Lines of a range merged by id as deltas: updated, repeated, new and absent ids."""
    spark, rows = fact.sparkSession, _detail(fact)

    def build(path):
        store.sync_range(spark, path, rows, _S0, _S1, full_detail=True)
        store.merge_lines(spark, path, _batch(rows), _R0, _R1)
        found = store.read_sales(spark, path)
        return found.groupBy(F.date_format("date", "yyyy-MM").alias("period")).agg(F.count("*").alias("lines"), F.count_if(F.col("client_key").startswith("N")).alias("new_lines"), F.sum("amount").alias("amount"))

    return _on_store(spark, build)


@C.add("line_merge_by_id", with_fact(
    """SELECT period, count(DISTINCT line_id) AS lines, count(DISTINCT line_id) FILTER (client_key LIKE 'N%') AS new_lines, CAST(sum(amount) AS DOUBLE) AS amount FROM (
      SELECT period, line_id, client_key, amount FROM own WHERE NOT (date BETWEEN DATE '2001-05-10' AND DATE '2001-06-20' AND CAST(client_key AS INT) % 3 <> 0) UNION ALL SELECT period, line_id, client_key, amount FROM batch) GROUP BY period""", _OWN, _BATCH))
def line_merge_by_id(fact):
    """The same batch without a range: absent ids stay. The deltas are then folded into their months."""
    spark, rows = fact.sparkSession, _detail(fact)

    def build(path):
        store.sync_range(spark, path, rows, _S0, _S1, full_detail=True)
        store.merge_lines(spark, path, _batch(rows))
        store.merge_months(spark, path)
        found = store.read_sales(spark, path)
        return found.groupBy(F.date_format("date", "yyyy-MM").alias("period")).agg(F.count("*").alias("lines"), F.count_if(F.col("client_key").startswith("N")).alias("new_lines"), F.sum("amount").alias("amount"))

    return _on_store(spark, build)


@C.add("merge_outcome", with_fact(
    """SELECT count(*) FILTER (o.line_id IS NOT NULL AND b.line_id IS NOT NULL) AS matched, count(*) FILTER (o.line_id IS NOT NULL AND b.line_id IS NOT NULL AND o.amount <> b.amount) AS modified,
      count(*) FILTER (o.line_id IS NULL) AS upserted, count(*) FILTER (b.line_id IS NULL) AS deleted FROM old o FULL JOIN (SELECT line_id, sum(amount) AS amount FROM batch GROUP BY 1) b ON o.line_id = b.line_id""",
    _BATCH, """old AS (SELECT concat_ws('|', CAST(date AS VARCHAR), client_key, invoice, CAST(line_no AS VARCHAR), product_key) AS line_id, sum(amount) AS amount FROM fact WHERE date BETWEEN DATE '2001-05-10' AND DATE '2001-06-20' GROUP BY 1)"""))
def merge_outcome(fact):
    rows = _detail(fact).select("date", "client_key", "invoice", "line_key", "product_key", "amount", F.lit(0).cast("decimal(18,4)").alias("quantity"))
    return store.merge_outcome(store.compact_lines(rows), store.compact_lines(_batch(rows)), _R0, _R1)


@C.add("period_context", with_fact(
    """SELECT CAST(a AS VARCHAR) AS selected_start, CAST(z AS VARCHAR) AS selected_end, CAST(a - CAST(z - a + 1 AS INT) AS VARCHAR) AS comparison_start, CAST(a - 1 AS VARCHAR) AS comparison_end, z - a + 1 AS days,
      (year(z) - year(a)) * 12 + month(z) - month(a) + 1 AS months, rows FROM (SELECT min(date) AS a, max(date) AS z, count(DISTINCT line_id) AS rows FROM own)""", _OWN))
def period_context(fact):
    """The period of a store that nobody has chosen, from the manifest of its months."""
    spark = fact.sparkSession

    def build(path):
        store.sync_range(spark, path, _detail(fact), _S0, _S1, full_detail=True)
        return period.context(store.period_statistics(spark, path))

    return _on_store(spark, build)


@C.add("load_windows", with_fact(
    """SELECT 'analysis' AS kind, CAST(s - CAST(e - s + 1 AS INT) AS VARCHAR) AS load_start, CAST(e AS VARCHAR) AS load_end, (SELECT count(DISTINCT period) FROM fact WHERE period BETWEEN substr(CAST(s - CAST(e - s + 1 AS INT) AS VARCHAR), 1, 7) AND substr(CAST(e AS VARCHAR), 1, 7)) AS months,
        (SELECT count(DISTINCT line_id) FROM own WHERE period BETWEEN substr(CAST(s - CAST(e - s + 1 AS INT) AS VARCHAR), 1, 7) AND substr(CAST(e AS VARCHAR), 1, 7)) AS rows FROM (SELECT DATE '2001-07-01' AS s, DATE '2001-07-20' AS e)
      UNION ALL SELECT 'running month', CAST(l AS VARCHAR), CAST(e AS VARCHAR), (SELECT count(DISTINCT period) FROM fact WHERE period BETWEEN substr(CAST(l AS VARCHAR), 1, 7) AND '2001-07'), (SELECT count(DISTINCT line_id) FROM own WHERE period BETWEEN substr(CAST(l AS VARCHAR), 1, 7) AND '2001-07')
        FROM (SELECT DATE '2000-07-01' AS l, DATE '2001-07-20' AS e)""", _OWN))
def load_windows(fact):
    """What has to be read for an analysis and for a month dashboard: the window, and the months and rows that the manifest lists for it."""
    spark = fact.sparkSession
    chosen = Period(date(2001, 7, 1), date(2001, 7, 20), date(2001, 6, 11), date(2001, 6, 30))

    def build(path):
        store.sync_range(spark, path, _detail(fact), _S0, _S1, full_detail=True)
        months = store.period_statistics(spark, path)
        found = [period.load_plan(months, chosen, running).withColumn("kind", F.lit(name)) for name, running in (("analysis", False), ("running month", True))]
        return found[0].unionByName(found[1])

    return _on_store(spark, build)


@C.add("master_upsert", """SELECT CAST(p_partkey AS VARCHAR) AS product_key, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' nueva' ELSE p_brand END AS brand FROM part WHERE p_partkey % 13 <> 0
  UNION ALL SELECT 'N' || p_partkey, p_brand || ' nueva' FROM part WHERE p_partkey % 13 = 0 AND p_partkey % 3 = 0""", on_fact=False)
def master_upsert(spark, sf_dir):
    existing = masters.articles(spark, sf_dir).select("product_key", "brand")
    part = table(spark, sf_dir, "part")
    key = F.when(F.col("p_partkey") % 3 != 0, " ").when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("N"), F.col("p_partkey"))).otherwise(F.col("p_partkey").cast("string"))
    return store.upsert(existing, part.select(key.alias("product_key"), F.concat("p_brand", F.lit(" nueva")).alias("brand")), "product_key")


@C.add("retention", with_fact("SELECT period, count(*) AS rows FROM fact WHERE date >= DATE '2001-07-20' - 399 GROUP BY period"))
def retention(fact):
    return store.prune(fact, store.retention_cutoff(date(2001, 7, 20), 400)).groupBy("period").agg(F.count("*").alias("rows"))


_W0, _W1 = date(1996, 1, 1), date(2000, 12, 31)


def sync_runs(spark, sf_dir):
    """Every order as a sync run of its client: a range of up to 90 days, some failed, some empty."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cliente_"), F.col("o_custkey")).alias("entity"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("status"),
        day.alias("range_start"), F.date_add(day, (F.col("o_orderkey") % 90).cast("int")).alias("range_end"), (F.col("o_orderkey") % 4).alias("records_received"),
        (F.col("o_orderkey") % 8 == 0).alias("empty_confirmed"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("run_id"))


_RUNS = """runs AS (SELECT 'cliente_' || o_custkey AS entity, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS e,
    o_orderkey % 4 AS n, o_orderkey % 8 = 0 AS ec, o_orderdate AS ts, o_orderkey AS run_id FROM orders),
  okdays AS (SELECT DISTINCT entity, CAST(unnest(generate_series(greatest(s, DATE '1996-01-01'), least(e, DATE '2000-12-31'), INTERVAL 1 DAY)) AS DATE) AS d FROM runs
    WHERE status = 'success' AND (n > 0 OR ec) AND s <= DATE '2000-12-31' AND e >= DATE '1996-01-01'),
  alldays AS (SELECT entity, CAST(unnest(generate_series(DATE '1996-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT entity FROM runs)),
  miss AS (SELECT * FROM alldays EXCEPT SELECT * FROM okdays)"""


def _islands(days):
    return f"""SELECT entity, min(d) AS s, max(d) AS e FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY entity ORDER BY d) AS INT) AS g FROM {days}) GROUP BY entity, g"""


@C.add("coverage_intervals", f'WITH {_RUNS} SELECT entity, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end" FROM ({_islands("okdays")})', on_fact=False)
def coverage_intervals(spark, sf_dir):
    return store.covered_ranges(sync_runs(spark, sf_dir), _W0, _W1, by=("entity",))


@C.add("uncovered_ranges", f'WITH {_RUNS} SELECT entity, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end" FROM ({_islands("miss")})', on_fact=False)
def uncovered_ranges(spark, sf_dir):
    return store.uncovered_ranges(sync_runs(spark, sf_dir), _W0, _W1, by=("entity",))


@C.add("range_coverage", f"""WITH {_RUNS}, i AS ({_islands('miss')}), f AS (SELECT entity, min(s) AS s, arg_min(e, s) AS e FROM i GROUP BY 1)
  SELECT r.entity, f.s IS NULL AS covered, CAST(f.s AS VARCHAR) AS missing_start, CAST(f.e AS VARCHAR) AS missing_end FROM (SELECT DISTINCT entity FROM runs) r LEFT JOIN f USING (entity)""", on_fact=False)
def range_coverage(spark, sf_dir):
    return store.range_coverage(sync_runs(spark, sf_dir), _W0, _W1, by=("entity",))


# All runs as those of one store. The request begins before the first order and ends after the last possible day, so it has gaps at both ends.
_RUNS_ALL = _RUNS.replace("DATE '1996-01-01'", "DATE '1990-01-01'").replace("DATE '2000-12-31'", "DATE '2003-12-31'")


@C.add("coverage_of_store", f"""WITH {_RUNS_ALL}, all_ok AS (SELECT DISTINCT 'x' AS entity, d FROM okdays),
    all_miss AS (SELECT DISTINCT 'x' AS entity, d FROM alldays EXCEPT SELECT * FROM all_ok)
  SELECT 'covered' AS kind, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end" FROM ({_islands('all_ok')}) UNION ALL SELECT 'uncovered', CAST(s AS VARCHAR), CAST(e AS VARCHAR) FROM ({_islands('all_miss')})
  UNION ALL SELECT 'reused', CAST(s AS VARCHAR), CAST(e AS VARCHAR) FROM ({_islands('all_ok')})""", on_fact=False)
def coverage_of_store(spark, sf_dir):
    runs, start, end = sync_runs(spark, sf_dir), date(1990, 1, 1), date(2003, 12, 31)
    covered, missing = store.covered_ranges(runs, start, end, entity=None), store.uncovered_ranges(runs, start, end, entity=None)
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "start", "end")
    return tag(covered, "covered").unionByName(tag(missing, "uncovered")).unionByName(tag(store.reused_ranges(missing, start, end), "reused"))


@C.add("storage_status", with_fact("SELECT count(*) AS records, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, TRUE AS available FROM fact"))
def storage_status(fact):
    return store.storage_status(fact)


@C.add("last_runs", f"""WITH {_RUNS} SELECT entity, status, CAST(s AS VARCHAR) AS range_start, CAST(e AS VARCHAR) AS range_end, n AS records_received, ec AS empty_confirmed, run_id FROM runs
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, status DESC, s DESC, e DESC, n DESC, ec DESC, run_id DESC) = 1""", on_fact=False)
def last_runs(spark, sf_dir):
    return store.last_runs(sync_runs(spark, sf_dir)).drop("timestamp")


@C.add("latest_runs", f"WITH {_RUNS} SELECT entity, status, run_id FROM runs ORDER BY ts DESC, run_id DESC LIMIT 20", on_fact=False)
def latest_runs(spark, sf_dir):
    runs = sync_runs(spark, sf_dir).withColumn("timestamp", F.struct("timestamp", "run_id"))
    return store.latest_runs(runs).select("entity", "status", "run_id")


_CHUNKS = """chunks AS (SELECT s + CAST(31 * i AS INT) AS chunk_start, least(s + CAST(31 * i + 30 AS INT), e) AS chunk_end FROM (VALUES (DATE '2000-01-01', DATE '2000-06-15'), (DATE '2001-02-01', DATE '2001-04-10')) v(s, e), range(0, 10) t(i)
    WHERE s + CAST(31 * i AS INT) <= e),
  ctot AS (SELECT CAST(chunk_start AS VARCHAR) AS chunk_start, CAST(chunk_end AS VARCHAR) AS chunk_end, count(f.date) AS rows_read, count(f.date) FILTER (f.has_article_match) AS rows_valid,
      count(DISTINCT (f.client_key, f.invoice, f.product_key, f.seller_key, f.date, f.channel)) FILTER (f.date IS NOT NULL) AS rows_stored
    FROM chunks LEFT JOIN fact f ON f.date BETWEEN chunks.chunk_start AND chunks.chunk_end GROUP BY 1, 2)"""
_FETCHED = [(date(2000, 1, 1), date(2000, 6, 15)), (date(2001, 2, 1), date(2001, 4, 10))]


def _counted(fact):
    """Chunks of the fetched ranges, counted while they are written compactly."""
    spark = fact.sparkSession
    totals = []

    def build(path):
        totals.extend(store.sync_ranges(spark, path, _detail(fact), _FETCHED, valid=F.col("has_article_match"))[1])
        return store.chunk_rows(spark, totals)

    return _on_store(spark, build)


@C.add("chunk_totals", with_fact("SELECT * FROM ctot", _CHUNKS))
def chunk_totals(fact):
    return _counted(fact)


@C.add("chunk_days", with_fact("SELECT chunk_start, chunk_end, rows_read, rows_valid FROM ctot", _CHUNKS))
def chunk_days(fact):
    """The same counts of lines already there, without writing them."""
    ranges = fact.sparkSession.createDataFrame(_FETCHED, "start date, end date")
    return store.chunk_totals(fact.select("date", F.col("has_article_match").alias("is_valid")), ranges)


# The request is 2000-01-01 to 2001-04-10; what lies between the fetched ranges was stored before.
@C.add("batch_totals", with_fact(
    """SELECT count(*) AS chunks, CAST(sum(rows_read) AS BIGINT) AS rows_read, CAST(sum(rows_valid) AS BIGINT) AS rows_valid, CAST(sum(rows_stored) AS BIGINT) AS rows_stored, min(chunk_start) AS first_date, max(chunk_end) AS last_date,
      '2000-01-01..2000-06-15, 2001-02-01..2001-04-10' AS fetched, '2000-06-16..2001-01-31' AS reused FROM ctot""", _CHUNKS))
def batch_totals(fact):
    spark = fact.sparkSession
    fetched = spark.createDataFrame(_FETCHED, "start date, end date")
    return store.batch_totals(_counted(fact), fetched, date(2000, 1, 1), date(2001, 4, 10))


@C.add("range_scan", with_fact("SELECT CAST(date AS VARCHAR) AS date, count(DISTINCT line_id) AS lines, CAST(sum(amount) AS DOUBLE) AS amount FROM own WHERE date BETWEEN DATE '2001-05-10' AND DATE '2001-06-20' GROUP BY 1", _OWN))
def range_scan(fact):
    """The days of a range from a store; months outside it are not listed."""
    spark = fact.sparkSession

    def build(path):
        store.sync_range(spark, path, _detail(fact), _S0, _S1, full_detail=True)
        return store.scan_range(spark, path, _R0, _R1).groupBy("date").agg(F.count("*").alias("lines"), F.sum("amount").alias("amount"))

    return _on_store(spark, build)


@C.add("source_fallback", with_fact("""SELECT 'main' AS source, count(DISTINCT line_id) AS lines FROM own WHERE date BETWEEN DATE '2001-05-10' AND DATE '2001-06-20'
    UNION ALL SELECT 'history', count(DISTINCT line_id) FROM own WHERE date BETWEEN DATE '2000-05-10' AND DATE '2001-06-20'""", _OWN))
def source_fallback(fact):
    """A range that the main store covers is read there, a longer one from the history."""
    spark, rows = fact.sparkSession, _detail(fact)

    def build(path):
        store.sync_range(spark, f"{path}/main", rows, date(2001, 1, 1), date(2001, 12, 31), f"{path}/log", full_detail=True)
        store.sync_range(spark, f"{path}/history", rows, _S0, _S1, full_detail=True)
        runs = spark.read.schema(store.RUN_SCHEMA).parquet(f"{path}/log")
        found = [store.load_with_fallback(spark, runs, f"{path}/main", f"{path}/history", a, _R1) for a in (_R0, date(2000, 5, 10))]
        counts = [df.agg(F.count("*").alias("lines")).select(F.lit(name).alias("source"), "lines") for df, name in found]
        return counts[0].unionByName(counts[1])

    return _on_store(spark, build)


@C.add("excel_dates", """SELECT o_orderkey AS order_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders""", on_fact=False)
def excel_dates(spark, sf_dir):
    """Order days as workbook serial numbers with a time of day, and back."""
    orders = table(spark, sf_dir, "orders")
    serial = F.date_diff(F.col("o_orderdate").cast("date"), F.lit(date(1899, 12, 30))) + (F.col("o_orderkey") % 24) / 24
    return orders.select(F.col("o_orderkey").alias("order_id"), serial_to_date(serial).alias("date"))


# A mapping for each customer: fields are mapped to columns or left out by the digits of the key.
@C.add("mapping_validation", """SELECT client, CASE WHEN NOT k OR NOT a THEN 'required' WHEN NOT d AND NOT (y AND m) THEN 'date' ELSE 'ok' END AS verdict,
    CASE WHEN NOT k AND NOT a THEN 'client_key, amount' WHEN NOT k THEN 'client_key' WHEN NOT a THEN 'amount' END AS missing,
    CAST(k AS INT) + CAST(a AS INT) + CAST(d AS INT) + CAST(y AS INT) + CAST(m AS INT) AS mapped
  FROM (SELECT c_custkey AS client, c_custkey % 7 <> 0 AS k, c_custkey % 5 <> 0 AS a, c_custkey % 2 = 0 AS d, c_custkey % 3 <> 0 AS y, c_custkey % 11 <> 0 AS m FROM customer)""", on_fact=False)
def mapping_validation(spark, sf_dir):
    c = F.col("c_custkey")
    entry = lambda field, there, column: F.struct(F.lit(field).alias("field"), F.when(there, F.lit(column)).otherwise(-1).alias("column"))
    fields = F.array(entry("client_key", c % 7 != 0, 0), entry("amount", c % 5 != 0, 1), entry("date", c % 2 == 0, 2), entry("year", c % 3 != 0, 3), entry("month", c % 11 != 0, 4), entry("unknown", F.lit(True), 5))
    mapped = table(spark, sf_dir, "customer").select(c.alias("client"), F.inline(fields))
    return mapping.validate_mappings(mapped, "sales", "client")


@C.add("analysis_runs", with_fact("""SELECT 'temporal_trend' AS name, 0 AS position, 'ok' AS status, count(DISTINCT period) AS rows FROM fact UNION ALL SELECT 'margin_analysis', 1, 'failed', NULL
    UNION ALL SELECT 'channel_analysis', 2, 'ok', count(DISTINCT channel) FROM fact UNION ALL SELECT 'geographic_coverage', 3, 'ok', count(DISTINCT coalesce(route_description, '')) FROM fact"""))
def analysis_runs(fact):
    """Four analyses side by side, one of which fails on a field that is not there; what the log says of them."""
    spark = fact.sparkSession
    dispatch = runs.Dispatch(spark)

    def build(path):
        found = runs.run_analyses(fact, ("temporal_trend", "margin_analysis", "channel_analysis", "geographic_coverage"), {"margin_analysis": {"revenue": "amount", "cost": "no_such_field"}}, dispatch)
        runs.log_run(spark, path, dispatch.run_id, found)
        return runs.read_log(spark, path).select("name", F.col("position").cast("long").alias("position"), "status", "rows")

    return _on_store(spark, build)


@C.add("prefilter_options", """WITH v AS (
    SELECT 'family' AS field, p_type AS value FROM part WHERE p_partkey % 13 <> 0 UNION ALL SELECT 'brand', p_brand FROM part WHERE p_partkey % 13 <> 0
    UNION ALL SELECT 'sales_force', r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'seller_name', n_name || CASE WHEN s_suppkey % 3 = 0 THEN ' B' ELSE '' END FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'sales_scheme_name', 'Esquema ' || s_suppkey % 4 FROM supplier UNION ALL SELECT 'sales_scheme_name', 'Esquema ' || c_custkey % 6 FROM customer
    UNION ALL SELECT 'route_description', 'Ruta ' || c_nationkey FROM customer)
  SELECT field, value, count(*) AS rows FROM v GROUP BY 1, 2""", on_fact=False)
def prefilter_options(spark, sf_dir):
    sellers = masters.sellers(spark, sf_dir).withColumn("sales_scheme_name", F.concat(F.lit("Esquema "), F.col("load_seq") % 4))
    customer = table(spark, sf_dir, "customer")
    routes = customer.select(F.concat(F.lit("Ruta "), "c_nationkey").alias("route_description"), F.concat(F.lit(" Esquema "), F.col("c_custkey") % 6).alias("sales_scheme_name"))
    return store.prefilter_options(masters.articles(spark, sf_dir), sellers, routes)
