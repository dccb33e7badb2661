"""Consistency report over the selected rows."""

from pyspark.sql import DataFrame, functions as F

from ventara.functions.numbers import dbl, ratio, share_pct, to_tenth
from ventara.operators.core import one_row


def consistency_totals(rows: DataFrame) -> DataFrame:
    """Totals, distinct counts, coverage and row defects.

    Distinct values are reduced per (field, value) first and counted per field, so no task gathers them all. Duplicates are the rows beyond the first of each fact key, that is rows minus distinct keys.
    """
    total = F.count("*")
    fields = {"clients": F.nullif("client_key", F.lit("")), "sellers": F.col("seller_name"), "routes": F.col("route_description"), "products": F.nullif("product_key", F.lit("")), "keys": F.col("fact_key")}
    values = F.inline(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in fields.items()]))
    counted = rows.select(values).filter(F.col("value").isNotNull()).distinct().groupBy("field").agg(F.count("*").alias("n"))
    numbers = one_row(counted, *[F.coalesce(F.max(F.when(F.col("field") == n, F.col("n"))), F.lit(0)).alias(n) for n in fields])
    row = rows.agg(
        total.alias("rows"),
        dbl(F.coalesce(F.sum("amount"), F.lit(0))).alias("sales"),
        dbl(F.coalesce(F.sum("quantity"), F.lit(0))).alias("quantity"),
        F.count("fact_key").alias("keyed"),
        share_pct(F.count("route_description"), total).alias("route_pct"),
        share_pct(F.count("seller_name"), total).alias("seller_pct"),
        share_pct(F.count_if("has_article_match"), total).alias("article_pct"),
        share_pct(F.count("channel"), total).alias("channel_pct"),
        F.count("date").alias("dated_rows"),
        F.count_if(F.abs(F.coalesce("amount", F.lit(0))) < 0.0001).alias("zero_rows"),
        F.count_if(F.col("amount") < 0).alias("negative_rows"),
    )
    row = row.select("*", *[numbers[n].alias(n) for n in fields if n != "keys"], (F.col("keyed") - numbers["keys"]).alias("duplicates")).drop("keyed")
    return row.select(
        "*", ratio("clients", "routes").alias("clients_per_route"),
        share_pct("duplicates", "rows").alias("duplicate_pct"), share_pct("dated_rows", "rows").alias("dated_pct"),
    )


def consistency_months(rows: DataFrame) -> DataFrame:
    """Rows with a client per month."""
    return rows.filter(F.nullif("client_key", F.lit("")).isNotNull()).groupBy("period").agg(F.count("*").alias("rows"))


def consistency_checks(totals: DataFrame) -> DataFrame:
    """The nine checks with their severity, each carrying the overall status."""

    def below(value, critical, warn):
        return F.when(value < critical, "critical").when(value < warn, "warn").otherwise("ok")

    duplicate = to_tenth("duplicate_pct")
    checks = [
        ("Duplicados de hechos", F.when(duplicate > 2, "critical").when(duplicate > 0, "warn").otherwise("ok"), "duplicate_pct"),
        ("Cobertura de rutas", below(to_tenth("route_pct"), 75, 90), "route_pct"),
        ("Cobertura de vendedores", below(to_tenth("seller_pct"), 75, 90), "seller_pct"),
        ("Cobertura de artículos", below(to_tenth("article_pct"), 75, 90), "article_pct"),
        ("Cobertura de canal", below(to_tenth("channel_pct"), 80, 95), "channel_pct"),
        ("Cardinalidad de rutas", below(F.round("clients_per_route", 2), 0.75, 2), "clients_per_route"),
        ("Filas con importe cero", F.when(F.col("zero_rows") > 0, "warn").otherwise("ok"), "zero_rows"),
        ("Filas negativas", F.when(F.col("negative_rows") > 0, "warn").otherwise("ok"), "negative_rows"),
        ("Fechas válidas", F.when(F.col("dated_rows") == F.col("rows"), "ok").otherwise("critical"), "dated_pct"),
    ]
    structs = F.array(*[
        F.struct(F.lit(i).cast("long").alias("position"), F.lit(n).alias("name"), s.alias("severity"), dbl(m).alias("metric"))
        for i, (n, s, m) in enumerate(checks, start=1)
    ])
    rank = lambda c: F.when(c.severity == "critical", 2).when(c.severity == "warn", 1).otherwise(0)
    worst = F.array_max(F.transform("checks", rank))
    status = F.when(worst == 2, "critical").when(worst == 1, "warn").otherwise("ok")
    return totals.select(structs.alias("checks")).select(status.alias("status"), F.inline_outer("checks"))
