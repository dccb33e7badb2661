"""Faceted filters over the fact."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ventara.functions.dates import MONTH_WORDS
from ventara.functions.rows import literal_rows
from ventara.functions.text import MISSING_LABEL, blank_to_null, label_of, lower_trim
from ventara.plans.period import Period
from ventara.plans.schema import FILTER_FIELDS

# Limits beyond which a selection is too broad to keep when it returns nothing.
BROAD_SHARE = 0.85
BROAD_ROUTES = 25

NUMERIC_FIELDS = ("year", "month")


def month_name(number) -> Column:
    """Spanish month name of a month number."""
    names = F.array(*[F.lit(words[1].capitalize()) for words in MONTH_WORDS.values()])
    return F.get(names, number - 1)


def facet_value(field: str) -> Column:
    """Value of a filter field as text; NULL when there is none."""
    if field in NUMERIC_FIELDS:
        return F.col(field).cast("int").cast("string")
    return label_of(field) if field in MISSING_LABEL else blank_to_null(field)


def clean_selection(field: str, values) -> list[str]:
    """Distinct usable values of a selection, in the form they are compared in."""
    if values is None or values == "":
        return []
    values = values if isinstance(values, (list, tuple, set)) else [values]
    texts = [str(v).strip() for v in values if v is not None and str(v).strip() != ""]
    if field == "month":
        by_word = {w: n for n, words in MONTH_WORDS.items() for w in words}
        numbers = [int(t) if t.isdigit() else by_word.get(t.lower(), 0) for t in texts]
        texts = [str(n) for n in numbers if 1 <= n <= 12]
    elif field == "year":
        digits = ["".join(c for c in t if c.isdigit()) for t in texts]
        texts = [d for d in digits if len(d) == 4 and 1900 <= int(d) <= 2100]
    return list(dict.fromkeys(t.lower() for t in texts))


def normalize_filters(filters: dict | None) -> dict[str, list[str]]:
    return {f: clean_selection(f, v) for f, v in (filters or {}).items() if f in FILTER_FIELDS}


def matches(field: str, values: list[str]) -> Column:
    """Whether a row's value is selected; an empty selection matches nothing, nor does a missing value."""
    return F.coalesce(F.lower(facet_value(field)).isin(values), F.lit(False)) if values else F.lit(False)


def apply_filters(fact: DataFrame, filters: dict | None) -> DataFrame:
    """Rows that match every filtered field."""
    selected = normalize_filters(filters)
    if not selected:
        return fact
    return fact.filter(reduce(and_, [matches(f, v) for f, v in selected.items()]))


def without_field(filters: dict | None, *fields: str) -> dict:
    return {k: v for k, v in (filters or {}).items() if k not in fields}


def facet_options(fact: DataFrame, filters: dict | None = None, period: Period | None = None, fields=FILTER_FIELDS) -> DataFrame:
    """Options and row counts per field, each field counted under the other fields' filters.

    One pass: every row is tagged with the filters it fails. A row failing none counts for all
    fields, a row failing exactly one counts for that field alone, and the others are dropped
    before the rows are unpivoted.
    """
    selected = normalize_filters(filters)
    values = [F.struct(F.lit(f).alias("field"), facet_value(f).alias("value")) for f in fields]
    rows = fact.select(F.array(*values).alias("facets"), *[(~matches(f, v)).alias(f"fails_{f}") for f, v in selected.items()])
    if selected:
        failed = F.filter(F.array(*[F.when(F.col(f"fails_{f}"), F.lit(f)) for f in selected]), lambda f: f.isNotNull())
        rows = rows.withColumn("failed", failed).filter(F.size("failed") <= 1)
        keep = F.filter("facets", lambda x: (F.size("failed") == 0) | (x.field == F.get("failed", 0)))
        rows = rows.select(keep.alias("facets"))
    # The outer form keeps the optimizer from copying the facet expressions into filters below every join.
    counts = rows.select(F.inline_outer("facets")).filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("n"))
    if period:
        months = [(int(x[:4]), int(x[5:7])) for x in period.labels]
        fill = {("year", str(y)) for y, _ in months} | {("month", str(m)) for _, m in months}
        fill = sorted((f, v, 0) for f, v in fill if f in fields)
        if fill:
            zeros = literal_rows(fact.sparkSession, ["field", "value", "n"], fill, {"n": "bigint"})
            counts = counts.unionByName(zeros).groupBy("field", "value").agg(F.sum("n").alias("n"))
    label = F.when(F.col("field") == "month", month_name(F.col("value").try_cast("int"))).otherwise(F.col("value"))
    return counts.select("field", "value", label.alias("label"), F.col("n").alias("rows"))


def order_options(options: DataFrame) -> DataFrame:
    """Presentation order: years newest first, months ascending, texts ignoring case."""
    position = F.create_map(*[F.lit(x) for i, f in enumerate(FILTER_FIELDS) for x in (f, i)])
    number = F.when(F.col("field").isin(*NUMERIC_FIELDS), F.col("value").try_cast("int"))
    return options.orderBy(
        F.try_element_at(position, F.col("field")),
        F.when(F.col("field") == "year", -number).otherwise(number),
        lower_trim("value"), "value",
    )


def filter_usage(universe: DataFrame, filters: dict, period: Period | None = None) -> DataFrame:
    """Per filtered field: values selected, values available and whether all available ones are selected."""
    selected = {f: v for f, v in normalize_filters(filters).items()}
    if not selected:
        raise ValueError("no filters given")
    facets = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lower(facet_value(f)).alias("marker"), F.array(*[F.lit(x) for x in v]).cast("array<string>").alias("chosen"))
        for f, v in selected.items()
    ])
    rows = universe.select(F.inline_outer(facets)).filter(F.col("marker").isNotNull()).select("field", "marker").distinct()
    if period:
        months = [(int(x[:4]), int(x[5:7])) for x in period.labels]
        fill = {("year", str(y)) for y, _ in months} | {("month", str(m)) for _, m in months}
        fill = sorted(x for x in fill if x[0] in selected)
        if fill:
            rows = rows.unionByName(literal_rows(universe.sparkSession, ["field", "marker"], fill)).distinct()
    chosen = literal_rows(
        universe.sparkSession, ["field", "marker", "chosen"], [(f, x, True) for f, v in selected.items() for x in v],
    ) if any(selected.values()) else None
    usage = rows if chosen is None else rows.join(chosen, ["field", "marker"], "left")
    hit = F.lit(False) if chosen is None else F.coalesce("chosen", F.lit(False))
    sizes = literal_rows(universe.sparkSession, ["field", "selected"], [(f, len(v)) for f, v in selected.items()], {"selected": "bigint"})
    counts = usage.groupBy("field").agg(F.count("*").alias("available"), F.count_if(~hit).alias("not_selected"))
    joined = sizes.join(counts, "field", "left").na.fill(0, ["available", "not_selected"])
    chosen_any = F.col("selected") > 0
    broad = (F.col("available") > 0) & (F.col("selected") / F.greatest(F.col("available"), F.lit(1)) >= BROAD_SHARE)
    return joined.select(
        "field", "selected", "available",
        (chosen_any & (F.col("available") > 0) & (F.col("not_selected") == 0)).alias("no_effect"),
        (chosen_any & (broad | ((F.col("field") == "route_description") & (F.col("selected") >= BROAD_ROUTES)))).alias("broad"),
    )


def _drop_flagged(universe, filters, period, flag) -> dict:
    known = {f: v for f, v in (filters or {}).items() if f in FILTER_FIELDS}
    if not known:
        return {}
    flagged = {row.field for row in filter_usage(universe, known, period).filter(flag).select("field").collect()}
    return without_field(known, *flagged)


def remove_no_effect(universe: DataFrame, filters: dict | None, period: Period | None = None) -> dict:
    """Filters without those that select every available value (one row per field comes back)."""
    return _drop_flagged(universe, filters, period, "no_effect")


def relax_broad(universe: DataFrame, filters: dict | None, period: Period | None = None) -> dict:
    """Filters without the broad ones; used when a selection returned nothing."""
    return _drop_flagged(universe, filters, period, "broad")


def focus_supplier(filters: dict | None, supplier: str | None) -> dict:
    """Filters narrowed to one supplier: the intersection with any supplier already selected."""
    name = (supplier or "").strip()
    merged = dict(filters or {})
    if name:
        present = clean_selection("supplier", merged.get("supplier"))
        merged["supplier"] = [name] if not present else [v for v in present if v == name.lower()]
    return merged


def filter_for_report(fact: DataFrame, filters: dict | None, universe: DataFrame, period: Period, supplier: str | None = None) -> tuple[DataFrame, dict]:
    """Filtered fact and the filters in force; broad filters are dropped once if nothing is left."""
    wanted = focus_supplier(remove_no_effect(universe, filters, period), supplier)
    rows = apply_filters(fact, wanted)
    if rows.isEmpty():
        wanted = relax_broad(universe, wanted, period)
        rows = apply_filters(fact, wanted)
        if rows.isEmpty():
            raise ValueError("no sales match the filters")
    return rows, wanted
