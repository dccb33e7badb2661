"""Untyped rows of files into the sales, article, route and seller schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ventara.functions.dates import month_start, parse_date, parse_month, parse_year
from ventara.functions.numbers import MEASURE, parse_number
from ventara.functions.text import blank_to_null, clean, file_key
from ventara.plans.schema import DATASET_FIELDS
from ventara.sources.mapping import check_mapping


def _cell(mapping: dict[str, int], field: str) -> Column:
    return F.coalesce(F.get("cells", mapping[field]), F.lit("")) if field in mapping else F.lit("")


def normalise_sales(rows: DataFrame, mapping: dict) -> DataFrame:
    """Sales lines of `rows` (file, row_no, cells). Lines without date, amount or client are dropped."""
    m = check_mapping("sales", mapping)
    cell = lambda f: _cell(m, f)
    number = lambda f: parse_number(cell(f))
    day = F.coalesce(parse_date(cell("date")), month_start(parse_year(cell("year")), parse_month(cell("month"))))
    lines = rows.select(
        F.col("file").alias("source"), "row_no", day.alias("date"), parse_year(cell("year")).alias("year"), parse_month(cell("month")).alias("month"),
        file_key(cell("client_key")).alias("client_key"), number("amount").alias("amount"),
        *[number(f).alias(f) for f in ("amount_net", "amount_final", "internal_taxes", "quantity")],
        *[file_key(cell(f)).alias(f) for f in ("seller_key", "sales_scheme_key", "product_key")],
        *[clean(cell(f)).alias(f) for f in ("client_name", "seller_name", "sales_scheme_name", "route_description", "product_name", "invoice", "channel")],
    )
    lines = lines.filter(F.col("date").isNotNull() & F.col("amount").isNotNull() & (F.col("client_key") != ""))
    zero = F.lit(0).cast(MEASURE)
    net, taxes = F.coalesce("amount_net", "amount"), F.coalesce("internal_taxes", zero)
    no_invoice = F.concat_ws("-", "source", "client_key", F.col("date").cast("string"), F.col("row_no").cast("string"))
    name = lambda f, other: F.coalesce(blank_to_null(f), other)
    return lines.select(
        "date", F.coalesce("year", F.year("date")).alias("year"), F.coalesce("month", F.month("date")).alias("month"),
        "client_key", name("client_name", F.col("client_key")).alias("client_name"), "route_description", "seller_key", "seller_name",
        "sales_scheme_key", "sales_scheme_name", "product_key", "product_name", name("invoice", no_invoice).alias("invoice"), "channel", "amount",
        net.cast(MEASURE).alias("amount_net"), F.coalesce("amount_final", "amount").cast(MEASURE).alias("amount_final"),
        taxes.cast(MEASURE).alias("internal_taxes"), (net + taxes).cast(MEASURE).alias("amount_net_internal"),
        F.coalesce("quantity", zero).cast(MEASURE).alias("quantity"), "source",
    )


def _normalise_master(rows: DataFrame, dataset: str, mapping: dict, keys) -> DataFrame:
    m = check_mapping(dataset, mapping)
    fields = [(file_key(_cell(m, f)) if f in keys else clean(_cell(m, f))).alias(f) for f in DATASET_FIELDS[dataset]]
    return rows.select(*fields, F.col("row_no").alias("load_seq"))


def normalise_articles(rows: DataFrame, mapping: dict) -> DataFrame:
    return _normalise_master(rows, "articles", mapping, ("product_key",)).filter(F.col("product_key") != "")


def normalise_routes(rows: DataFrame, mapping: dict) -> DataFrame:
    return _normalise_master(rows, "routes", mapping, ()).filter(F.col("seller_name") != "")


def normalise_sellers(rows: DataFrame, mapping: dict) -> DataFrame:
    sellers = _normalise_master(rows, "sellers", mapping, ("seller_key",))
    some = reduce(lambda a, b: a | b, [F.col(f) != "" for f in DATASET_FIELDS["sellers"]])
    return sellers.filter(some).withColumn("seller_name", F.coalesce(blank_to_null("seller_name"), F.col("seller_key")))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Sales of several sources as one frame; a column a source lacks is NULL there."""
    if not frames:
        raise ValueError("no sales source given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def source_counts(raw: DataFrame, valid: DataFrame) -> DataFrame:
    """Rows read and rows valid per source."""
    read = raw.groupBy(F.col("file").alias("source")).agg(F.count("*").alias("rows_read"))
    kept = valid.groupBy("source").agg(F.count("*").alias("rows_valid"))
    return read.join(kept, "source", "left").na.fill(0, ["rows_valid"])


def require_rows(df: DataFrame, what: str = "sales") -> DataFrame:
    """The frame itself, or an error when it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no valid rows: {what}")
    return df
