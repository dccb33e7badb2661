"""Column profile, role inference and the analyses a dataset allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ventara.functions.numbers import dbl
from ventara.functions.rows import literal_rows
from ventara.functions.text import clean, lower_trim
from ventara.operators.core import ranked
from ventara.plans.session import kept

DATE, DIMENSION, METRIC, IDENTIFIER = "FECHA", "DIMENSIÓN", "MÉTRICA", "IDENTIFICADOR"

# Role and subrole of the known fields.
FIELD_ROLES = {
    "date": (DATE, None), "year": (DATE, "FECHA_AÑO"), "month": (DATE, "FECHA_MES"),
    "client_key": (IDENTIFIER, "ID_CLIENTE"), "invoice": (IDENTIFIER, "ID_COMPROBANTE"),
    "product_key": (IDENTIFIER, "ID_PRODUCTO"), "seller_key": (IDENTIFIER, "ID_VENDEDOR"),
    "client": (DIMENSION, "DIM_CLIENTE"), "client_name": (DIMENSION, "DIM_CLIENTE"),
    "seller_name": (DIMENSION, "DIM_VENDEDOR"), "sales_scheme_name": (DIMENSION, "DIM_ESQUEMA_VENTAS"),
    "sales_force": (DIMENSION, "DIM_FUERZA"), "route_description": (DIMENSION, "DIM_RUTA"),
    "product_name": (DIMENSION, "DIM_PRODUCTO"), "family": (DIMENSION, "DIM_FAMILIA"),
    "line": (DIMENSION, "DIM_LINEA"), "supplier": (DIMENSION, "DIM_PROVEEDOR"),
    "flavor": (DIMENSION, "DIM_SABOR"), "caliber": (DIMENSION, "DIM_CALIBRE"), "uxb": (DIMENSION, "DIM_UXB"),
    "channel": (DIMENSION, "DIM_CANAL"), "amount": (METRIC, "MET_VENTA"), "quantity": (METRIC, "MET_CANTIDAD"),
}

# Labels that count as missing.
MISSING_SENTINELS = (
    "Sin vendedor", "Sin ruta", "Sin familia", "Sin canal", "Sin fuerza de ventas", "Sin proveedor",
    "Sin línea", "Sin sabor", "Sin UxB", "Sin calibre", "Sin producto", "Sin artículo",
)

# Words in a header that give its role; the first line that applies wins.
HEADER_WORDS = (
    (("fecha", "date", "periodo", "año", "mes", "year", "month", "dia", "día"), DATE, None),
    (("cliente", "customer", "cta", "cuenta", "razon social", "razón social"), DIMENSION, "DIM_CLIENTE"),
    (("vendedor", "asesor", "ejecutivo", "preventa", "rep ventas"), DIMENSION, "DIM_VENDEDOR"),
    (("articulo", "artículo", "producto", "sku", "item", "descripcion articulo"), DIMENSION, "DIM_PRODUCTO"),
    (("familia", "rubro", "categoria", "categoría"), DIMENSION, "DIM_FAMILIA"),
    (("ruta", "recorrido", "territorio"), DIMENSION, "DIM_RUTA"),
    (("canal", "segmento", "subcanal"), DIMENSION, "DIM_CANAL"),
    (("fuerza", "fza ventas", "fuerza ventas"), DIMENSION, "DIM_FUERZA"),
    (("linea", "línea"), DIMENSION, "DIM_LINEA"),
    (("proveedor", "supplier"), DIMENSION, "DIM_PROVEEDOR"),
    (("importe", "monto", "venta", "total", "neto", "facturado", "ingreso"), METRIC, "MET_VENTA"),
    (("costo", "cost", "compra"), METRIC, "MET_COSTO"),
    (("cantidad", "unidades", "qty", "cant"), METRIC, "MET_CANTIDAD"),
)

# Words in a field name that give the subrole of an inferred metric or dimension.
METRIC_WORDS = ((("costo", "cost", "compra"), "MET_COSTO"), (("cantidad", "unidades", "qty", "cant"), "MET_CANTIDAD"))
DIMENSION_WORDS = (
    (("cliente", "customer", "cta"), "DIM_CLIENTE"), (("vendedor", "asesor", "seller"), "DIM_VENDEDOR"),
    (("familia", "rubro"), "DIM_FAMILIA"), (("ruta", "recorrido"), "DIM_RUTA"), (("canal", "channel"), "DIM_CANAL"),
    (("fuerza", "fza"), "DIM_FUERZA"), (("articulo", "artículo", "producto", "sku"), "DIM_PRODUCTO"),
)

# What each analysis needs: (roles, subroles).
ANALYSIS_NEEDS = {
    "temporal_trend": ((DATE, METRIC), ()),
    "dimension_ranking": ((DIMENSION, METRIC), ()),
    "recurrence_churn": ((DATE,), ("DIM_CLIENTE", "MET_VENTA")),
    "cross_sell_mix": ((), ("DIM_CLIENTE", "DIM_FAMILIA")),
    "seller_performance": ((), ("DIM_VENDEDOR", "MET_VENTA")),
    "geographic_coverage": ((), ("DIM_RUTA", "MET_VENTA")),
    "margin_analysis": ((), ("MET_COSTO", "MET_VENTA")),
    "sales_force_breakdown": ((), ("DIM_FUERZA", "MET_VENTA")),
    "product_analysis": ((), ("DIM_PRODUCTO", "MET_VENTA")),
    "channel_analysis": ((), ("DIM_CANAL", "MET_VENTA")),
}

_SALE = ("MET_VENTA", "MET_CANTIDAD")
# Domain, priority, field slots (subroles in order of preference; a slot that lists only
# one cannot be left open) and the dimensions an analysis can be split by.
TASKS = {
    "temporal_trend": ("tiempo", 1, {"date": ("FECHA", "FECHA_AÑO", "FECHA_MES"), "metric": _SALE},
                       ("DIM_VENDEDOR", "DIM_FUERZA", "DIM_CANAL", "DIM_FAMILIA", "DIM_RUTA", "DIM_CLIENTE")),
    "dimension_ranking": ("cartera", 1, {"metric": _SALE},
                          ("DIM_CLIENTE", "DIM_VENDEDOR", "DIM_FUERZA", "DIM_FAMILIA", "DIM_RUTA", "DIM_CANAL",
                           "DIM_PRODUCTO", "DIM_PROVEEDOR", "DIM_LINEA")),
    "recurrence_churn": ("cartera", 1, {"date": ("FECHA",), "client": ("DIM_CLIENTE", "ID_CLIENTE"), "metric": _SALE},
                         ("DIM_VENDEDOR", "DIM_FUERZA", "DIM_RUTA", "DIM_CANAL")),
    "cross_sell_mix": ("producto", 2, {"client": ("DIM_CLIENTE", "ID_CLIENTE"), "product": ("DIM_FAMILIA", "DIM_LINEA", "DIM_PRODUCTO")},
                       ("DIM_VENDEDOR", "DIM_FUERZA", "DIM_CANAL")),
    "seller_performance": ("territorio", 1, {"seller": ("DIM_VENDEDOR",), "metric": _SALE}, ("DIM_FUERZA", "DIM_RUTA", "DIM_CANAL")),
    "geographic_coverage": ("territorio", 2, {"route": ("DIM_RUTA",), "metric": _SALE}, ("DIM_FUERZA", "DIM_VENDEDOR")),
    "margin_analysis": ("margen", 1, {"revenue": ("MET_VENTA",), "cost": ("MET_COSTO",)},
                        ("DIM_CLIENTE", "DIM_FAMILIA", "DIM_PRODUCTO", "DIM_VENDEDOR", "DIM_CANAL")),
    "sales_force_breakdown": ("territorio", 2, {"sales_force": ("DIM_FUERZA",), "metric": _SALE}, ("DIM_VENDEDOR", "DIM_RUTA", "DIM_CANAL")),
    "product_analysis": ("producto", 2, {"product": ("DIM_FAMILIA", "DIM_LINEA", "DIM_PRODUCTO"), "metric": _SALE},
                         ("DIM_PROVEEDOR", "DIM_LINEA", "DIM_CANAL", "DIM_CLIENTE")),
    "channel_analysis": ("canal", 2, {"channel": ("DIM_CANAL",), "metric": _SALE}, ("DIM_FAMILIA", "DIM_VENDEDOR", "DIM_FUERZA")),
}
# Analyses that take a pair of dimensions, and the order of the domains.
CROSSED = ("dimension_ranking",)
DOMAINS = ("tiempo", "cartera", "territorio", "producto", "canal", "margen")
MIN_COMBO_COVERAGE = 0.10


def _contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _first_rule(text: Column, rules, default=None) -> Column:
    out = F.lit(default).cast("string")
    for words, value in reversed(rules):
        out = F.when(_contains_any(text, words), F.lit(value).cast("string")).otherwise(out)
    return out


def header_role(header) -> Column:
    """Role and subrole from the words in a header; NULL role when no word applies."""
    text = lower_trim(header)
    return F.struct(
        _first_rule(text, [(w, r) for w, r, _ in HEADER_WORDS]).alias("role"),
        _first_rule(text, [(w, s) for w, _, s in HEADER_WORDS]).alias("subrole"),
    )


def content_role(field, rows, dates, numbers, distinct_values, distinct_numbers, low, high) -> Column:
    """Role and subrole from what a column holds."""
    name = F.lower(field)
    date_like = dbl(dates) / F.greatest(dbl(rows), F.lit(1.0)) >= 0.7
    numeric = dbl(numbers) / F.greatest(dbl(rows), F.lit(1.0)) >= 0.8
    month = (distinct_numbers <= 12) & (low >= 1) & (high <= 12)
    year = (distinct_numbers <= 30) & (low >= 1900) & (high <= 2100)
    unique = dbl(distinct_values) / F.greatest(dbl(rows), F.lit(1.0)) > 0.8
    role = (
        F.when(date_like, DATE).when(numeric & (month | year), DATE).when(numeric, METRIC)
        .when(unique, IDENTIFIER).otherwise(DIMENSION)
    )
    subrole = (
        F.when(date_like, F.lit(None).cast("string"))
        .when(numeric & month, "FECHA_MES").when(numeric & year, "FECHA_AÑO")
        .when(numeric, _first_rule(name, METRIC_WORDS, "MET_VENTA"))
        .when(unique, F.lit(None).cast("string")).otherwise(_first_rule(name, DIMENSION_WORDS))
    )
    return F.struct(role.alias("role"), subrole.alias("subrole"))


def _typed(kind) -> bool:
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))


def _is_present(df: DataFrame, field: str) -> Column:
    return F.col(field).isNotNull() if _typed(df.schema[field].dataType) else (clean(field) != "") & ~F.col(field).isin(*MISSING_SENTINELS)


def _long(df: DataFrame, fields) -> DataFrame:
    """One row per present cell: field, text, and the number or date flag its type or content gives."""
    cells = []
    for f in fields:
        kind = df.schema[f].dataType
        number = F.col(f).cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        dated = F.lit(_typed(kind) and not isinstance(kind, (T.NumericType, T.BooleanType)))
        cells.append(F.struct(F.lit(f).alias("field"), F.when(_is_present(df, f), F.col(f).cast("string")).alias("value"), number.alias("number"), dated.alias("dated")))
    return df.select(F.inline_outer(F.array(*cells))).filter(F.col("value").isNotNull())


def _raw_long(rows: DataFrame, headers: str = "headers", cells: str = "cells") -> DataFrame:
    """Cells of untyped rows, with number and date read from their text."""
    pairs = F.arrays_zip(F.col(headers).alias("field"), F.col(cells).alias("value"))
    flat = rows.select(F.inline_outer(pairs)).toDF("field", "value")
    flat = flat.filter(F.col("field").isNotNull() & (clean("value") != ""))
    return flat.select(
        "field", "value", F.col("value").try_cast("double").alias("number"),
        F.try_to_date(F.substring("value", 1, 10), "yyyy-MM-dd").isNotNull().alias("dated"),
    )


def _counted(long: DataFrame) -> DataFrame:
    return long.groupBy("field", "value").agg(F.count("*").alias("n"), F.max("number").alias("number"), F.max("dated").alias("dated"))


def _most_frequent(counted: DataFrame, top: int) -> DataFrame:
    """The first values of each field. Its order names all columns, so that Spark counts the values once for this and for the statistics."""
    order = [F.desc("n"), "value", "number", "dated"]
    return ranked(counted, top, order, by=["field"]).groupBy("field").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x.value.alias("value"), x.n.alias("n"))).alias("top"))


def _reported(stats: DataFrame, total: Column) -> DataFrame:
    """The profile of fields with `role`, `subrole`, `rows`, `distinct_values` and `top`."""
    listed = F.col("role").isin(DIMENSION, IDENTIFIER)
    return stats.select(
        "field", "role", "subrole",
        (dbl("rows") / F.greatest(dbl(total), F.lit(1.0))).alias("coverage"),
        F.when(listed, F.col("distinct_values")).alias("cardinality"),
        F.when(listed, F.col("top")).alias("top_values"),
    )


def _content(counted: DataFrame, known_role: Column) -> DataFrame:
    """Rows, distinct values and the role of each field: the known one, else that of its values."""
    stats = counted.groupBy("field").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("dated"), F.col("n"))), F.lit(0)).alias("dates"),
        F.coalesce(F.sum(F.when(F.col("number").isNotNull(), F.col("n"))), F.lit(0)).alias("numbers"),
        F.count("*").alias("distinct_values"),
        F.count_distinct("number").alias("distinct_numbers"),
        F.min("number").alias("low"), F.max("number").alias("high"),
    )
    inferred = content_role(*[F.col(c) for c in ("field", "rows", "dates", "numbers", "distinct_values", "distinct_numbers", "low", "high")])
    role = F.when(known_role.role.isNotNull(), known_role).otherwise(inferred)
    return stats.withColumn("r", role).select("field", "rows", "distinct_values", F.col("r.role").alias("role"), F.col("r.subrole").alias("subrole"))


def _unknown() -> Column:
    return F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("subrole"))


def _by_content(long: DataFrame, known_role: Column, top: int) -> DataFrame:
    """What `_reported` needs, from all values. Left joins: where most frequent values are not read, they are not made."""
    counted = _counted(long)
    return _content(counted, known_role).join(_most_frequent(counted, top), "field", "left")


def profile(df: DataFrame, fields=None, top: int = 5) -> DataFrame:
    """One row per column: role, coverage, and for dimensions and identifiers cardinality and top values.

    Columns without any value are left out. Present cells of all columns are counted by one plain aggregate. Values are counted apart from it,
    per (column, value) first, so a value that fills most of a column is reduced before the shuffle: those of known dimensions and identifiers,
    which give only cardinality and top values, and those of the other columns, which give their roles as well.
    """
    fields = list(fields or df.columns)
    listed = [f for f in fields if FIELD_ROLES.get(f, (None,))[0] in (DIMENSION, IDENTIFIER)]
    others = [f for f in fields if f not in FIELD_ROLES]
    figures = df.agg(F.count("*").alias("total"), *[F.count_if(_is_present(df, f)).alias(f"n{i}") for i, f in enumerate(fields)])
    roles = [FIELD_ROLES.get(f, (None, None)) for f in fields]
    lines = [F.struct(F.lit(f).alias("field"), F.lit(r).cast("string").alias("role"), F.lit(s).cast("string").alias("subrole"), F.col(f"n{i}").alias("rows")) for i, (f, (r, s)) in enumerate(zip(fields, roles))]
    cells = figures.select("total", F.inline(F.array(*lines))).filter("rows > 0")
    found = cells.filter(F.col("role").isNotNull())
    if listed:
        counted = _counted(_long(df, listed))
        values = counted.groupBy("field").agg(F.count_if(F.col("n") > 0).alias("distinct_values"))
        found = found.join(values, "field", "left").join(_most_frequent(counted, top), "field", "left")
    else:
        found = found.withColumns({"distinct_values": F.lit(None).cast("long"), "top": F.lit(None).cast("array<struct<value:string,n:bigint>>")})
    report = _reported(found, F.col("total"))
    if others:
        content = _by_content(_long(df, others), _unknown(), top).join(cells.select("field", "total"), "field")
        report = report.unionByName(_reported(content, F.col("total")))
    return report


def profile_raw(rows: DataFrame, top: int = 5) -> DataFrame:
    """Profile of untyped rows (headers and cells arrays): roles from header words, else from content."""
    total = rows.agg(F.count("*")).scalar()
    return _reported(_by_content(_raw_long(rows), header_role("field"), top), total)


def infer_roles(df: DataFrame, fields) -> DataFrame:
    """Roles from content alone, whatever the columns are called."""
    total = df.agg(F.count("*")).scalar()
    return _reported(_by_content(_long(df, fields), _unknown(), 1), total).select("field", "role", "subrole", "coverage")


def subrole_fields(profiled: DataFrame) -> DataFrame:
    """Best covered field per subrole, with its coverage and (if profiled) cardinality; a plain date column also serves the subrole FECHA."""
    plain_date = (F.col("role") == DATE) & F.col("subrole").isNull()
    rows = profiled.withColumn("subrole", F.when(plain_date, F.lit(DATE)).otherwise(F.col("subrole")))
    return rows.filter(F.col("subrole").isNotNull()).groupBy("subrole").agg(
        *[F.min_by(c, F.struct(-F.col("coverage"), F.col("field"))).alias(c) for c in ("field", "coverage", "cardinality") if c in profiled.columns])


def dimension_order(profiled: DataFrame) -> DataFrame:
    """Dimensions by coverage, then by fewest values."""
    return profiled.filter(F.col("role") == DIMENSION).orderBy(F.desc("coverage"), F.coalesce("cardinality", F.lit(0)), "field")


def date_range(df: DataFrame, field: str = "date") -> DataFrame:
    return df.agg(F.min(field).alias("min_date"), F.max(field).alias("max_date"))


def _present(profiled: DataFrame) -> DataFrame:
    roles = F.explode(F.array("role", "subrole")).alias("need")
    return profiled.select(roles).filter(F.col("need").isNotNull()).distinct().withColumn("found", F.lit(True))


def available_analyses(profiled: DataFrame) -> DataFrame:
    """Analyses whose required roles and subroles are all present."""
    needs = [(a, n) for a, (roles, subroles) in ANALYSIS_NEEDS.items() for n in roles + subroles]
    table = literal_rows(profiled.sparkSession, ["analysis", "need"], needs)
    return (
        table.join(_present(profiled), "need", "left").groupBy("analysis")
        .agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("ok")).filter("ok").select("analysis")
    )


def resolve_slots(profiled: DataFrame) -> DataFrame:
    """Field for every slot of the analyses that can run; optional slots may stay without a field.

    Roles and coverage are computed once for all that reads them, and kept: a row per column. Value lists are not read, so they are not made.
    """
    profiled = kept(profiled.select("field", "role", "subrole", "coverage"))
    wishes = [
        (a, slot, i, s, len(prefs) > 1)
        for a, (_, _, slots, _) in TASKS.items() for slot, prefs in slots.items() for i, s in enumerate(prefs)
    ]
    table = literal_rows(profiled.sparkSession, ["analysis", "slot", "preference", "subrole", "optional"], wishes)
    found = table.join(subrole_fields(profiled).select("subrole", "field"), "subrole", "left")
    slots = found.groupBy("analysis", "slot").agg(
        F.min_by("field", F.when(F.col("field").isNotNull(), F.col("preference"))).alias("field"),
        F.bool_or("optional").alias("optional"),
    )
    blocked = slots.filter(F.col("field").isNull() & ~F.col("optional")).select("analysis").distinct()
    return slots.join(available_analyses(profiled), "analysis", "left_semi").join(blocked, "analysis", "left_anti").select("analysis", "slot", "field")


def slots_of(profiled: DataFrame, analysis: str) -> dict[str, str]:
    """The fields an analysis runs on, by slot; empty when it cannot run. A few rows at most."""
    return {r["slot"]: r["field"] for r in resolve_slots(profiled).filter(F.col("analysis") == analysis).collect() if r["field"]}


def tasks(profiled: DataFrame) -> DataFrame:
    """Analyses that can run, by domain and priority."""
    catalog = [(a, d, DOMAINS.index(d), p, i) for i, (a, (d, p, _, _)) in enumerate(TASKS.items())]
    table = literal_rows(profiled.sparkSession, ["analysis", "domain", "domain_rank", "priority", "catalog_rank"], catalog)
    runnable = resolve_slots(profiled).select("analysis").distinct()
    return table.join(runnable, "analysis", "left_semi").orderBy("domain_rank", "priority", "catalog_rank")


def combos(profiled: DataFrame) -> DataFrame:
    """Single dimensions and (for rankings) pairs each runnable analysis can be split by."""
    wishes = [(a, i, s) for a, (_, _, _, dims) in TASKS.items() for i, s in enumerate(dims)]
    table = literal_rows(profiled.sparkSession, ["analysis", "pos", "subrole"], wishes)
    usable = subrole_fields(profiled).filter(F.col("coverage") >= MIN_COMBO_COVERAGE).select("subrole", "field")
    runnable = resolve_slots(profiled).select("analysis").distinct()
    dims = table.join(usable, "subrole").join(runnable, "analysis", "left_semi")
    single = dims.select("analysis", F.col("field").alias("dim_a"), F.lit(None).cast("string").alias("dim_b"), F.col("pos").alias("pos_a"), F.lit(-1).alias("pos_b"))
    crossed = dims.filter(F.col("analysis").isin(*CROSSED))
    later = crossed.select("analysis", F.col("field").alias("dim_b"), F.col("pos").alias("pos_b"))
    pairs = crossed.select("analysis", F.col("field").alias("dim_a"), F.col("pos").alias("pos_a")).join(later, "analysis").filter("pos_a < pos_b")
    return single.unionByName(pairs)
