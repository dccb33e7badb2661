"""Which column of a file holds which field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ventara.functions.text import lower_trim
from ventara.plans.schema import DATASET_FIELDS, REQUIRED_FIELDS

# Words that point to a field, per dataset.
FIELD_WORDS = {
    "sales": {
        "date": ("fecha", "fec", "date", "periodo", "periodo fecha", "día", "dia"),
        "year": ("año", "ano", "year", "ejercicio"),
        "month": ("mes", "month", "periodo mes", "periodo"),
        "client_key": ("cod cliente", "codigo cliente", "id cliente", "cliente codigo", "cta", "cuenta", "nro cliente"),
        "client_name": ("cliente", "razon social", "razón social", "nombre cliente", "customer"),
        "route_description": ("ruta", "recorrido", "hoja de ruta", "descripcion ruta", "descripción ruta"),
        "seller_key": ("cod vendedor", "codigo vendedor", "id vendedor", "legajo vendedor"),
        "seller_name": ("vendedor", "asesor", "ejecutivo", "preventa", "rep"),
        "sales_scheme_key": ("cod esquema", "codigo esquema", "id esquema", "id fuerza ventas", "id fuerza de ventas"),
        "sales_scheme_name": ("esquema", "esquema ventas", "esquema de ventas", "fuerza ventas", "fuerza de ventas"),
        "product_key": ("cod articulo", "codigo articulo", "sku", "cod producto", "id producto"),
        "product_name": ("articulo", "artículo", "producto", "descripcion articulo", "descripción artículo"),
        "invoice": ("factura", "comprobante", "pedido", "documento", "ticket"),
        "channel": ("canal", "segmento", "subcanal"),
        "amount": ("importe", "venta", "total", "neto", "monto", "facturado"),
        "amount_net": ("neto", "subtotal neto", "importe neto", "venta neta", "monto neto"),
        "amount_final": ("final", "subtotal final", "importe final", "venta final", "total final", "facturado final"),
        "internal_taxes": ("impuestos internos", "impuesto interno", "ii", "imp internos", "iibb interno"),
        "quantity": ("cantidad", "unidades", "qty", "cant"),
    },
    "articles": {
        "product_key": ("cod articulo", "codigo articulo", "sku", "cod producto", "id producto", "producto estadístico", "producto estadistico"),
        "product_name": ("articulo", "artículo", "producto", "descripcion articulo", "descripción artículo", "detalle producto"),
        "family": ("familia", "rubro", "categoria", "categoría"),
        "line": ("linea", "línea"),
        "brand": ("marca",),
        "business_unit": ("unidad de negocio", "negocio"),
        "segment": ("segmento",),
        "division": ("division", "división"),
        "supplier": ("proveedor",),
        "flavor": ("sabor",),
        "uxb": ("uxb", "u x b", "unid x bulto", "unidades por bulto"),
        "caliber": ("calibre",),
    },
    "routes": {
        "sales_force": ("fuerza de ventas", "fza ventas", "fza", "fuerza"),
        "seller_name": ("vendedor", "asesor", "ejecutivo", "preventa"),
        "route_description": ("descripcion ruta", "descripción ruta", "ruta", "recorrido", "hoja de ruta"),
    },
    "sellers": {
        "seller_key": ("cod vendedor", "codigo vendedor", "id vendedor", "legajo"),
        "seller_name": ("vendedor", "asesor", "ejecutivo", "preventa", "nombre vendedor"),
        "route_description": ("ruta", "recorrido", "descripcion ruta", "descripción ruta", "hoja de ruta"),
        "sales_force": ("fuerza de ventas", "fza ventas", "fza", "fuerza"),
    },
}


def score_header(header: Column, words) -> Column:
    """Letters of all words a header contains."""
    text = lower_trim(header)
    return reduce(lambda a, b: a + b, [F.when(text.contains(w), len(w)).otherwise(0) for w in words])


def suggest_mapping(headers: DataFrame, dataset: str = "sales") -> DataFrame:
    """Best column per field and sheet; the leftmost wins a tie, and a field without a hit has none.

    The scores are expressions over the headers array, so nothing is joined.
    """
    words = FIELD_WORDS.get(dataset, FIELD_WORDS["sales"])
    candidates = headers.select("file", "sheet", F.posexplode("headers").alias("column", "header"))
    scores = F.array(*[F.struct(F.lit(f).alias("field"), score_header(F.col("header"), w).alias("score")) for f, w in words.items()])
    hits = candidates.select("file", "sheet", "column", "header", F.inline_outer(scores)).filter(F.col("score") > 0)
    best = hits.groupBy("file", "sheet", "field").agg(F.max_by(F.struct("column", "header", "score"), F.struct("score", -F.col("column"))).alias("b"))
    return best.select("file", "sheet", "field", "b.column", "b.header", "b.score")


def check_mapping(dataset: str, mapping: dict) -> dict[str, int]:
    """Positions of the mapped fields; raises when a required one is missing."""
    known = {f: int(mapping[f]) for f in DATASET_FIELDS[dataset] if mapping.get(f) not in (None, "", -1)}
    missing = [f for f in REQUIRED_FIELDS[dataset] if f not in known]
    if missing:
        raise ValueError(f"{dataset}: no column for {', '.join(missing)}")
    if dataset == "sales" and "date" not in known and not {"year", "month"} <= set(known):
        raise ValueError("sales: needs a date column, or a year and a month column")
    return known


def validate_mappings(mapped: DataFrame, dataset: str, *by: str) -> DataFrame:
    """What check_mapping says of many mappings at once: (by, field, column) rows to a verdict per mapping, as one aggregation.

    `verdict`: ok, required (a required field is missing, see `missing`) or date (neither a date nor a year and a month). `mapped` counts known fields.
    """
    has = lambda f: F.bool_or((F.col("field") == f) & F.coalesce(F.col("column") >= 0, F.lit(False))).alias(f"has_{f}")
    wanted = list(dict.fromkeys([*REQUIRED_FIELDS[dataset], *(("date", "year", "month") if dataset == "sales" else ())]))
    known = F.col("field").isin(*DATASET_FIELDS[dataset]) & F.coalesce(F.col("column") >= 0, F.lit(False))
    found = mapped.groupBy(*by).agg(*map(has, wanted), F.count_distinct(F.when(known, F.col("field"))).alias("mapped"))
    missing = F.concat_ws(", ", *[F.when(~F.col(f"has_{f}"), F.lit(f)) for f in REQUIRED_FIELDS[dataset]])
    dated = F.col("has_date") | (F.col("has_year") & F.col("has_month")) if dataset == "sales" else F.lit(True)
    return found.select(*by, F.when(missing != "", "required").when(~dated, "date").otherwise("ok").alias("verdict"), F.nullif(missing, F.lit("")).alias("missing"), "mapped")
