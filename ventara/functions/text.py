"""Text and key expressions."""

from pyspark.sql import Column, functions as F

# Accented letters and their plain forms.
ACCENTED = "áéíóúüñ"
PLAIN = "aeiouun"

# Label shown for a missing dimension value.
MISSING_LABEL = {
    "seller_name": "Sin vendedor",
    "sales_force": "Sin fuerza de ventas",
    "sales_scheme_name": "Sin esquema",
    "route_description": "Sin ruta",
    "channel": "Sin canal",
    "family": "Sin familia",
    "line": "Sin línea",
    "brand": "Sin marca",
    "business_unit": "Sin unidad de negocio",
    "segment": "Sin segmento",
    "division": "Sin división",
    "supplier": "Sin proveedor",
    "flavor": "Sin sabor",
    "uxb": "Sin UxB",
    "caliber": "Sin calibre",
}


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x) -> Column:
    """Trimmed text, '' when missing."""
    return F.coalesce(F.trim(col(x).cast("string")), F.lit(""))


def blank_to_null(x) -> Column:
    return F.nullif(F.trim(col(x).cast("string")), F.lit(""))


def first_text(*xs) -> Column:
    """First value that is not blank, else NULL."""
    return F.coalesce(*[blank_to_null(x) for x in xs])


def label_of(field: str, source=None) -> Column:
    """Value of a dimension, or its missing label."""
    return F.coalesce(
        blank_to_null(field if source is None else source),
        F.lit(MISSING_LABEL.get(field, f"Sin {field}")),
    )


def file_key(x, zero_is_missing: bool = True) -> Column:
    """Key from a workbook cell: trimmed, upper case; a zero cell counts as missing."""
    key = F.upper(clean(x))
    return F.when(key == "0", F.lit("")).otherwise(key) if zero_is_missing else key


def erp_key(x) -> Column:
    """Key from an ERP payload: '' and '0' are missing; whole numbers lose leading zeros and decimals (12.0 becomes 12)."""
    text = F.nullif(blank_to_null(x), F.lit("0"))
    plain = F.regexp_replace(text, r"\.(?=[0-9.]*,0*$)", "")  # thousands dots of 1.234,00
    return F.regexp_replace(plain, r"^\+?(-?)0*([0-9]+)(?:[.,]0*)?$", "$1$2")


def lower_trim(x) -> Column:
    return F.lower(clean(x))


def folded(x) -> Column:
    """Lower case, no accents, single spaces: the form used to match names."""
    plain = F.translate(F.lower(clean(x)), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def is_missing_label(x) -> Column:
    text = lower_trim(x)
    return (text == "") | text.startswith("sin ")


def is_operational_route(x) -> Column:
    return F.replace(clean(x), F.lit(" "), F.lit("")).rlike("^0{3,4}-")


def natural_order(x) -> Column:
    """Sort key that puts numeric text first, by value."""
    text = clean(x)
    number = F.when(text.rlike("^[0-9]+$"), text.cast("decimal(38,0)"))
    return F.struct(number.isNull().alias("is_text"), number.alias("number"), text.alias("text"))
