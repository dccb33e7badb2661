"""ERP payloads (JSON) into sales lines and masters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ventara.functions.numbers import MEASURE, first_number
from ventara.functions.text import blank_to_null, clean, erp_key, first_text, lower_trim, natural_order

# Fields of the payloads. All are read as text; numbers and keys are parsed afterwards.
SALE_FIELDS = (
    "anulado", "fechaComprobate", "fechaEntrega", "fechaAlta", "fechaPedido", "subtotalFinal", "totalFinal", "importeFinal",
    "subtotalNeto", "totalNeto", "importeNeto", "subtotalImpuestosInternos", "impuestosInternos", "impuestoInterno", "impInterno",
    "impInternos", "subtotalBruto", "idCliente", "nombreCliente", "idVendedor", "dsVendedor", "desRuta", "planillaCarga",
    "idArticuloEstadistico", "idArticulo", "dsArticuloEstadistico", "dsArticulo", "dsSegmentoMkt", "dsCanalMkt", "dsSubcanalMKT",
    "dsNegocio", "cantidadesTotal", "unimedtotal", "cantidadSolicitada", "unidadesSolicitadas", "idMovComercial", "idDocumento",
    "idLinea", "letra", "serie", "nrodoc", "idPedido", "idFuerzaVentas", "dsFuerzaVentas", "rowVersion",
)
ARTICLE_SCHEMA = (
    "anulado boolean, idArticuloEstadistico string, idArticulo string, desArticulo string, unidadesBulto string, rowVersion string, "
    "eAgrupaciones array<struct<idFormaAgrupar:string,desFormaAgrupar:string,desAgrupacion:string>>"
)
STAFF_FIELDS = (
    "idPersonal", "desPersonal", "apellido", "idFuerzaVentas", "desFuerzaVentas", "idSucursal", "desSucursal", "cargo", "tipoVenta",
    "idPersonalSuperior", "desPersonalSuperior", "rowVersion",
)
ROUTE_SCHEMA = (
    "idRuta string, desRuta string, fechaDesde string, fechaHasta string, anulado boolean, idPersonal string, desPersonal string, "
    "idFuerzaVentas string, desFuerzaVentas string, idSucursal string, desSucursal string, desModoAtencion string, diasVisita string, "
    "diasEntrega string, eClientesRutas array<struct<idCliente:string>>"
)
MARKETING_SCHEMA = (
    "idSegmentoMkt string, desSegmentoMkt string, CanalesMkt array<struct<idCanalMkt:string,desCanalMkt:string,"
    "SubCanalesMkt:array<struct<idSubcanalMkt:string,desSubcanalMkt:string>>>>"
)

# Grouping names an article attribute is taken from, in order of preference.
GROUP_ALIASES = {
    "family": ("FAMILIA",), "line": ("LINPRODU", "LINEA", "LINEAS DE PRODUCTO"), "supplier": ("ROTACION", "PROVEEDOR"),
    "flavor": ("SABOR", "SABORES"), "brand": ("MARCA", "MARCASAB"), "business_unit": ("UNIDAD DE NEGOCIO",), "segment": ("SEGMENTO",),
    "division": ("DIVISION",), "generic": ("GENERICO",), "mark_flavor": ("MARCASAB",), "caliber": ("CALIBRE",),
}


#: Name under which the second spelling of rowVersion is read.
OTHER_VERSION = "row_version_2"


def text_schema(fields) -> str:
    return ", ".join(f"{f} string" for f in fields)


def read_erp_json(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON records with a declared schema; `load_seq` orders them by file path and place in the file.

    Spark packs files into tasks by size, so the row number of a task orders rows inside a file block only.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    if "rowVersion" not in schema:
        return spark.read.schema(schema).json(path).withColumn("load_seq", place)
    # the version comes in two spellings that a reader cannot tell apart, so the text is read and the second spelling renamed
    lines = spark.read.text(path).select(F.regexp_replace("value", r'"rowversion"(\s*:)', f'"{OTHER_VERSION}"$1').alias("value"), place.alias("load_seq")).where("trim(value) <> ''")
    told = lines.select(F.from_json("value", f"{schema}, {OTHER_VERSION} string").alias("r"), "load_seq").select("r.*", "load_seq")
    return told.withColumn("rowVersion", F.coalesce(blank_to_null("rowVersion"), blank_to_null(OTHER_VERSION))).drop(OTHER_VERSION)


def _with(df: DataFrame, fields) -> DataFrame:
    missing = {f: F.lit(None).cast("string") for f in fields if f not in df.columns}
    return df.withColumns(missing) if missing else df


def iso_day(x) -> Column:
    return F.try_to_date(F.substring(blank_to_null(x), 1, 10), "yyyy-MM-dd")


def erp_sales(rows: DataFrame, source: str = "ERP") -> DataFrame:
    """Sales lines of raw rows: cancelled ones and those without date, amount or client are dropped. `source` names where they come from."""
    rows = _with(rows, SALE_FIELDS)
    final = first_number("subtotalFinal", "totalFinal", "importeFinal")
    net = first_number("subtotalNeto", "totalNeto", "importeNeto")
    invoice = F.nullif(F.concat_ws("-", *[blank_to_null(f) for f in ("idDocumento", "letra", "serie", "nrodoc")]), F.lit(""))
    zero = F.lit(0).cast(MEASURE)
    lines = rows.filter(clean("anulado") != "SI").select(
        "rowVersion", F.coalesce(erp_key("idMovComercial"), erp_key("idDocumento")).alias("document_key"), erp_key("idLinea").alias("line_key"),
        iso_day(first_text("fechaComprobate", "fechaEntrega", "fechaAlta", "fechaPedido")).alias("date"),
        erp_key("idCliente").alias("client_key"), blank_to_null("nombreCliente").alias("name"),
        clean("desRuta").alias("commercial_route"), clean("planillaCarga").alias("route_sheet"),
        erp_key("idVendedor").alias("seller_key"), clean("dsVendedor").alias("seller_name"),
        erp_key("idFuerzaVentas").alias("sales_scheme_key"), clean("dsFuerzaVentas").alias("sales_scheme_name"),
        F.coalesce(erp_key("idArticuloEstadistico"), erp_key("idArticulo")).alias("product_key"),
        F.coalesce(first_text("dsArticuloEstadistico", "dsArticulo"), F.lit("")).alias("product_name"),
        clean("dsSegmentoMkt").alias("segment_name"), clean("dsCanalMkt").alias("channel_name"), clean("dsSubcanalMKT").alias("subchannel_name"),
        F.coalesce(first_text("dsSubcanalMKT", "dsCanalMkt", "dsSegmentoMkt", "dsNegocio"), F.lit("")).alias("channel"),
        F.coalesce(invoice, erp_key("idPedido"), F.lit("ERP")).alias("invoice"),
        F.coalesce(final, net, first_number("subtotalBruto")).alias("amount"), net.alias("net"), final.alias("final"),
        F.coalesce(first_number("subtotalImpuestosInternos", "impuestosInternos", "impuestoInterno", "impInterno", "impInternos"), zero).alias("internal_taxes"),
        F.coalesce(first_number("cantidadesTotal", "unimedtotal", "cantidadSolicitada", "unidadesSolicitadas"), zero).alias("quantity"),
    )
    lines = lines.filter(F.col("date").isNotNull() & F.col("amount").isNotNull() & F.col("client_key").isNotNull())
    amount_net = F.coalesce("net", "amount")
    return lines.select(
        F.col("rowVersion").alias("row_version"), "document_key", "line_key",
        F.when(F.col("line_key").isNotNull(), "line").otherwise("summary").alias("detail_level"),
        "date", F.year("date").alias("year"), F.month("date").alias("month"), "client_key", F.coalesce("name", "client_key").alias("client_name"),
        F.coalesce(first_text("commercial_route", "route_sheet"), F.lit("")).alias("route_description"), "commercial_route", "route_sheet",
        "seller_key", "seller_name", "sales_scheme_key", "sales_scheme_name", F.col("sales_scheme_key").alias("sales_force_key"),
        F.col("sales_scheme_name").alias("sales_force"), "product_key", "product_name", "segment_name", "channel_name", "subchannel_name",
        "invoice", "channel", "amount", amount_net.alias("amount_net"), F.coalesce("final", "amount").alias("amount_final"), "internal_taxes",
        (amount_net + F.col("internal_taxes")).cast(MEASURE).alias("amount_net_internal"), "quantity", F.lit(source).alias("source"),
    )


def last_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """The row with the highest load_seq per key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "load_seq").alias("r")).select(*keys, "r.*")


def erp_articles(rows: DataFrame) -> DataFrame:
    """Article master: attributes from the groupings list, last record per product."""
    named = F.transform("eAgrupaciones", lambda g: F.struct(
        F.upper(first_text(g.idFormaAgrupar, g.desFormaAgrupar)).alias("k"), blank_to_null(g.desAgrupacion).alias("v")))
    usable = F.filter(named, lambda e: e.k.isNotNull() & e.v.isNotNull())
    # A grouping listed twice counts with its last value: look the name up from the end.
    groups = F.reverse(F.coalesce(usable, F.array().cast("array<struct<k:string,v:string>>")))
    pick = lambda alias: F.get(F.filter("groups", lambda e: e.k == alias), 0).v
    articles = rows.filter(~F.coalesce("anulado", F.lit(False))).select(
        "load_seq", "rowVersion", F.coalesce(erp_key("idArticuloEstadistico"), erp_key("idArticulo")).alias("product_key"),
        blank_to_null("desArticulo").alias("name"), blank_to_null("unidadesBulto").alias("uxb"), groups.alias("groups"),
    ).filter(F.col("product_key").isNotNull())
    master = articles.select(
        "load_seq", F.col("rowVersion").alias("row_version"), "product_key", F.coalesce("name", "product_key").alias("product_name"),
        *[F.coalesce(*[pick(a) for a in aliases]).alias(f) for f, aliases in GROUP_ALIASES.items()], "uxb",
    )
    return last_per_key(master, "product_key")


def erp_staff(rows: DataFrame, source: str = "ERP") -> DataFrame:
    """Seller master: per key the best of duplicates (salesperson, with force, with version, by name)."""
    rows = _with(rows, STAFF_FIELDS)
    key = erp_key("idPersonal")
    staff = rows.select(
        "load_seq", F.col("rowVersion").alias("row_version"), key.alias("seller_key"), F.coalesce(first_text("desPersonal", "apellido"), key).alias("seller_name"),
        erp_key("idFuerzaVentas").alias("sales_scheme_key"), clean("desFuerzaVentas").alias("sales_scheme_name"), erp_key("idFuerzaVentas").alias("sales_force_key"), clean("desFuerzaVentas").alias("sales_force"),
        erp_key("idSucursal").alias("branch_key"), clean("desSucursal").alias("branch_name"), clean("cargo").alias("role"), clean("tipoVenta").alias("sale_type"),
        erp_key("idPersonalSuperior").alias("supervisor_key"), clean("desPersonalSuperior").alias("supervisor_name"),
    ).filter(F.col("seller_key").isNotNull() | F.col("seller_name").isNotNull())
    priority = F.struct(
        (F.col("role") == "VENDEDOR").cast("int"), (F.col("sales_force") != "").cast("int"), blank_to_null("row_version").isNotNull().cast("int"),
        F.coalesce("seller_name", F.lit("")), "load_seq",
    )
    unique = F.coalesce("seller_key", lower_trim("seller_name"))
    best = staff.withColumn("k", unique).groupBy("k").agg(F.max_by(F.struct(*staff.columns), priority).alias("r"))
    return best.select("r.*", F.lit(source).alias("source")).drop("load_seq")


def erp_routes(rows: DataFrame, as_of: date) -> DataFrame:
    """Route master: the best of duplicates per branch, scheme, route and seller, with the clients of all of them."""
    start, end = iso_day("fechaDesde"), iso_day("fechaHasta")
    active = start.isNotNull() & end.isNotNull() & F.lit(as_of).between(start, end) & ~F.coalesce("anulado", F.lit(False))
    keys = F.filter(F.transform("eClientesRutas", lambda c: erp_key(c.idCliente)), lambda k: k.isNotNull())
    none = F.array().cast("array<string>")
    routes = rows.select(
        "load_seq", erp_key("idRuta").alias("route_key"), F.coalesce(blank_to_null("desRuta"), erp_key("idRuta")).alias("route_description"),
        erp_key("idPersonal").alias("seller_key"), clean("desPersonal").alias("seller_name"), erp_key("idFuerzaVentas").alias("sales_scheme_key"),
        clean("desFuerzaVentas").alias("sales_scheme_name"), erp_key("idFuerzaVentas").alias("sales_force_key"), clean("desFuerzaVentas").alias("sales_force"),
        erp_key("idSucursal").alias("branch_key"), clean("desSucursal").alias("branch_name"), clean("desModoAtencion").alias("mode"),
        clean("diasVisita").alias("visit_days"), clean("diasEntrega").alias("delivery_days"), start.cast("string").alias("valid_from"), end.cast("string").alias("valid_to"),
        F.coalesce(F.size("eClientesRutas"), F.lit(0)).cast("long").alias("listed"), F.coalesce(keys, none).alias("client_keys"), active.alias("is_active"),
    ).filter(F.col("route_description").isNotNull())
    routes = routes.withColumn("client_count", F.greatest("listed", F.lit(0).cast("long"))).drop("listed")
    unique = [F.coalesce(c, F.lit("")).alias(f"k_{c}") for c in ("branch_key", "sales_scheme_key", "route_key", "seller_key")]
    identity = ["k_branch_key", "k_sales_scheme_key", "k_route_key", "k_seller_key"]
    rank = F.struct(F.col("is_active").cast("int"), F.coalesce("valid_to", F.lit("")), F.coalesce("valid_from", F.lit("")), "client_count", "load_seq")
    value = [c for c in routes.columns if c not in ("client_keys", "load_seq")]
    tagged = routes.select("*", *unique)
    best = tagged.groupBy(*identity).agg(F.max_by(F.struct(*value), rank).alias("r"))
    # Distinct (route, client) pairs first, so a route repeated many times is reduced before it is listed.
    pairs = tagged.select(*identity, F.explode("client_keys").alias("client")).distinct()
    lists = pairs.groupBy(*identity).agg(
        F.transform(F.sort_array(F.collect_list(natural_order("client"))), lambda x: x.text).alias("client_keys"))
    return best.join(lists, identity, "left").select("r.*", F.coalesce("client_keys", none).alias("client_keys"))


def erp_marketing(segments: DataFrame) -> DataFrame:
    """Segment, channel and subchannel hierarchy as rows keyed by the deepest id present; the last one wins."""
    # Positions are zero-based; a missing level has none and sorts first.
    level = segments.select("load_seq", erp_key("idSegmentoMkt").alias("segment_key"), clean("desSegmentoMkt").alias("segment_name"), F.posexplode_outer("CanalesMkt").alias("p1", "c"))
    level = level.select(
        "load_seq", "segment_key", "segment_name", "p1", erp_key("c.idCanalMkt").alias("channel_key"), clean("c.desCanalMkt").alias("channel_name"),
        F.posexplode_outer("c.SubCanalesMkt").alias("p2", "s"))
    flat = level.select(
        F.struct("load_seq", F.coalesce("p1", F.lit(-1)).alias("p1"), F.coalesce("p2", F.lit(-1)).alias("p2")).alias("seq"),
        "segment_key", "segment_name", "channel_key", "channel_name", erp_key("s.idSubcanalMkt").alias("subchannel_key"), clean("s.desSubcanalMkt").alias("subchannel_name"))
    keyed = flat.withColumn("marketing_key", F.coalesce("subchannel_key", "channel_key", "segment_key")).filter(F.col("marketing_key").isNotNull())
    fields = ("segment_key", "segment_name", "channel_key", "channel_name", "subchannel_key", "subchannel_name")
    return keyed.groupBy("marketing_key").agg(F.max_by(F.struct(*fields), "seq").alias("r")).select("marketing_key", "r.*")


# --- masters derived from sales ---------------------------------------------------------------


def _last_filled(field: str, seq: str) -> Column:
    value = blank_to_null(field)
    return F.max_by(value, F.when(value.isNotNull(), F.col(seq))).alias(field)


SELLER_ATTRIBUTES = ("seller_key", "seller_name", "route_description", "sales_scheme_key", "sales_scheme_name", "sales_force")


def derived_sellers(sales: DataFrame, seq: str = "load_seq") -> DataFrame:
    """Seller master from sales lines: last filled value of every attribute per seller."""
    key = F.coalesce(blank_to_null("seller_key"), F.nullif(lower_trim("seller_name"), F.lit("")))
    rows = sales.withColumn("k", key).filter(F.col("k").isNotNull())
    out = rows.groupBy("k").agg(*[_last_filled(f, seq) for f in SELLER_ATTRIBUTES])
    return out.withColumn("seller_name", F.coalesce("seller_name", "seller_key")).drop("k")


def derived_routes(sales: DataFrame, seq: str = "load_seq") -> DataFrame:
    """Route master from sales lines, per route name or, without one, per seller."""
    key = F.nullif(lower_trim(first_text("route_description", "seller_name")), F.lit(""))
    rows = sales.withColumn("k", key).filter(F.col("k").isNotNull())
    out = rows.groupBy("k").agg(*[_last_filled(f, seq) for f in SELLER_ATTRIBUTES if f != "seller_key"])
    return out.select(
        "sales_force", F.coalesce("seller_name", "route_description").alias("seller_name"),
        F.coalesce("route_description", "seller_name").alias("route_description"), "sales_scheme_key", "sales_scheme_name")
