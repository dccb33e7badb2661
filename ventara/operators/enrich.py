"""Sales lines joined with article, seller and route masters into the fact.

Every lookup is a left equi-join on a key that is unique on the master side. Lookups by the name or key of
a seller or branch are reduced to one row per key first, and broadcast only if they are counted to be small;
lookups by client and by article are shuffled, while the sales lines carry resolved columns only.
Missing dimension values stay NULL; reports put the label in when they group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ventara.functions.dates import period_of, week_of
from ventara.functions.text import blank_to_null, clean, first_text, folded, is_operational_route
from ventara.plans.schema import ARTICLE_ATTRIBUTES
from ventara.plans.session import kept

#: Rows of a reduced lookup up to which it is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 20_000

# Fields of the masters.
MASTER_FIELDS = {
    "articles": ("product_key", *ARTICLE_ATTRIBUTES),
    "sellers": ("seller_key", "seller_name", "route_description", "sales_force"),
    "routes": (
        "route_description", "seller_key", "seller_name", "sales_force", "branch_name",
        "sales_scheme_key", "sales_force_key", "is_active", "valid_from", "valid_to", "client_count", "client_keys",
    ),
}
SALES_OPTIONAL = (
    "client_name", "route_description", "commercial_route", "seller_key", "seller_name", "sales_scheme_key",
    "sales_scheme_name", "sales_force", "sales_force_key", "product_key", "product_name", "invoice", "channel",
)


def _with_columns(df: DataFrame, names, kinds: dict[str, str] | None = None) -> DataFrame:
    kinds = kinds or {}
    missing = {n: F.lit(None).cast(kinds.get(n, "string")) for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def last_wins(df: DataFrame, key: Column, name: str, fields, order: list[Column]) -> DataFrame:
    """One struct per key: the row that comes last in `order`; equal rows are told apart by content."""
    value = F.struct(*fields)
    rows = df.select(key.alias("k"), value.alias("v"), F.struct(*order, value).alias("o"))
    rows = rows.filter(F.col("k").isNotNull())
    return rows.groupBy("k").agg(F.max_by("v", "o").alias(name))


def route_rank(route: str) -> Column:
    """Preference of a route: active first, then valid longest, valid latest, most clients."""
    r = lambda f: F.col(f"{route}.{f}") if route else F.col(f)
    return F.struct(
        F.when(F.coalesce(r("is_active"), F.lit(False)), 1).otherwise(0).alias("active"),
        F.coalesce(r("valid_to").cast("string"), F.lit("")).alias("to"),
        F.coalesce(r("valid_from").cast("string"), F.lit("")).alias("from"),
        F.coalesce(F.nullif(r("client_count").cast("long"), F.lit(0)), F.lit(0)).alias("clients"),
    )


def _sequence(df: DataFrame) -> list[Column]:
    return [F.col("load_seq")] if "load_seq" in df.columns else []


def article_lookup(articles: DataFrame) -> DataFrame:
    articles = _with_columns(articles, MASTER_FIELDS["articles"])
    return last_wins(articles, blank_to_null("product_key"), "article", MASTER_FIELDS["articles"], _sequence(articles))


def seller_lookups(sellers: DataFrame) -> dict[str, DataFrame]:
    """Seller rows by key, by route name and by seller name, tried in this order."""
    sellers = _with_columns(sellers, MASTER_FIELDS["sellers"])
    fields, order = MASTER_FIELDS["sellers"], _sequence(sellers)
    return {
        "by_key": last_wins(sellers, blank_to_null("seller_key"), "s_key", fields, order),
        "by_route": last_wins(sellers, F.nullif(folded("route_description"), F.lit("")), "s_route", fields, order),
        "by_name": last_wins(sellers, F.nullif(folded("seller_name"), F.lit("")), "s_name", fields, order),
    }


ROUTE_VALUE = ("route_description", "seller_key", "seller_name", "sales_force", "is_active", "valid_to", "valid_from", "client_count")


def _routes(routes: DataFrame) -> DataFrame:
    routes = _with_columns(
        routes, MASTER_FIELDS["routes"],
        {"is_active": "boolean", "client_count": "long", "client_keys": "array<string>"},
    )
    listed = F.coalesce(F.nullif(F.col("client_count").cast("long"), F.lit(0)), F.size("client_keys").cast("long"))
    return routes.withColumn("client_count", F.greatest(listed, F.lit(0)))


def route_lookups(routes: DataFrame) -> dict[str, DataFrame]:
    """Best route by seller name, and by client with and without scheme."""
    routes = _routes(routes)
    order = [route_rank("").alias("rank"), *_sequence(routes)]
    return {"by_seller": last_wins(routes, F.nullif(folded("seller_name"), F.lit("")), "r_seller", ROUTE_VALUE, order), "by_client": _client_routes(routes, order)}


def _client_routes(routes: DataFrame, order: list[Column]) -> DataFrame:
    """Per client the best route of all as `r_client`, and the best one of each scheme as the map `by_scheme`: one join serves both."""
    clients = routes.withColumn("client", F.explode("client_keys")).filter(clean("client") != "")
    value = F.struct(*ROUTE_VALUE)
    rows = clients.select(clean("client").alias("k"), first_text("sales_scheme_key", "sales_force_key").alias("scheme"), value.alias("v"), F.struct(*order, value).alias("o"))
    best = rows.groupBy("k", "scheme").agg(F.max_by("v", "o").alias("v"), F.max("o").alias("o"))
    pairs = F.collect_list(F.when(F.col("scheme").isNotNull(), F.struct("scheme", "v")))
    return best.groupBy("k").agg(F.max_by("v", "o").alias("v"), F.map_from_entries(pairs).alias("by_scheme")).select("k", F.struct(F.col("v").alias("r_client"), "by_scheme").alias("r"))


def organisation_names(routes: DataFrame) -> DataFrame:
    """Names of branches and sales forces, which are not accepted as route names."""
    routes = _routes(routes)
    names = F.array(folded("branch_name"), folded("sales_force"))
    return routes.select(F.explode(names).alias("k")).filter(F.col("k") != "").distinct().withColumn("is_unit", F.lit(True))


def _lookup(df: DataFrame, key: Column, table: DataFrame, name: str) -> DataFrame:
    if table is None:
        return df
    return df.withColumn("_k", key).join(table.withColumnRenamed("k", "_k"), "_k", "left").drop("_k")


def _small(table: DataFrame) -> DataFrame:
    """A lookup by name, reduced and kept, with a hint for broadcast when it has few rows."""
    table = kept(table)
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def enrich(sales: DataFrame, articles=None, routes=None, sellers=None) -> DataFrame:
    """The fact: sales lines plus resolved seller, route, force, scheme, article attributes and match flags."""
    df = _with_columns(sales, SALES_OPTIONAL)
    df = df.withColumn("sales_scheme_key", first_text("sales_scheme_key", "sales_force_key"))
    none = F.lit(None)
    seller_type = "struct<seller_key:string,seller_name:string,route_description:string,sales_force:string>"
    if sellers is not None:
        tables = seller_lookups(sellers)
        df = _lookup(df, blank_to_null("seller_key"), _small(tables["by_key"]), "s_key")
        df = _lookup(df, F.nullif(folded("route_description"), F.lit("")), _small(tables["by_route"]), "s_route")
        df = _lookup(df, F.nullif(folded("seller_name"), F.lit("")), _small(tables["by_name"]), "s_name")
        master = F.coalesce("s_key", "s_route", "s_name")
    else:
        master = none.cast(seller_type)
    df = df.withColumn("_master", master)
    df = df.withColumn("_seller", first_text("_master.seller_name", "seller_name", "seller_key"))

    route_type = (
        "struct<route_description:string,seller_key:string,seller_name:string,sales_force:string,"
        "is_active:boolean,valid_to:string,valid_from:string,client_count:bigint>"
    )
    if routes is not None:
        tables = route_lookups(routes)
        df = _lookup(df, folded("_seller"), _small(tables["by_seller"]), "r_seller")
        client = blank_to_null("client_key")
        df = _lookup(df, client, tables["by_client"], "r")
        of_scheme = F.try_element_at("r.by_scheme", F.col("sales_scheme_key"))
        df = df.withColumn("_client_route", F.coalesce(of_scheme, F.col("r.r_client"))).drop("r")
        client_wins = F.col("r_seller").isNull() | (route_rank("_client_route") >= route_rank("r_seller"))
        df = df.withColumn(
            "_route", F.when(F.col("_client_route").isNotNull() & client_wins, F.col("_client_route")).otherwise(F.col("r_seller"))
        )
    else:
        df = df.withColumn("_client_route", none.cast(route_type)).withColumn("_route", none.cast(route_type))

    overrides = blank_to_null("_client_route.seller_name").isNotNull()
    seller_name = F.when(overrides, first_text("_client_route.seller_name", "_seller")).otherwise(F.col("_seller"))
    seller_key = F.when(overrides, first_text("_client_route.seller_key", "seller_key")).otherwise(blank_to_null("seller_key"))
    usable = lambda c: F.when(~is_operational_route(c), blank_to_null(c))
    from_masters = F.coalesce(usable("_route.route_description"), usable("_master.route_description"))
    df = df.withColumn("_from_masters", from_masters).withColumn(
        "_name", F.coalesce("_from_masters", usable("commercial_route"), usable("route_description"))
    )
    if routes is not None:
        df = _lookup(df, folded("_name"), _small(organisation_names(routes)), "is_unit")
        route_name = F.when(F.col("is_unit").isNotNull(), F.col("_from_masters")).otherwise(F.col("_name"))
    else:
        route_name = F.col("_name")
    resolved = df.select(
        *[c for c in sales.columns if c not in (
            "client_name", "seller_key", "seller_name", "sales_scheme_key", "sales_scheme_name", "sales_force",
            "channel", "route_description", "invoice", "product_key", *ARTICLE_ATTRIBUTES)],
        "client_name", "product_key", "invoice",
        seller_key.alias("seller_key"),
        seller_name.alias("seller_name"),
        "sales_scheme_key",
        first_text("sales_scheme_name", "sales_force", "_route.sales_force").alias("sales_scheme_name"),
        first_text("sales_scheme_name", "sales_force", "_route.sales_force", "_master.sales_force").alias("sales_force"),
        blank_to_null("channel").alias("channel"),
        route_name.alias("route_description"),
        (F.col("_master").isNotNull() | seller_key.isNotNull() | blank_to_null("seller_name").isNotNull()).alias("has_seller_match"),
    )
    names = resolved.columns
    if articles is not None:
        resolved = _lookup(resolved, blank_to_null("product_key"), article_lookup(articles), "article")
    else:
        resolved = resolved.withColumn("article", none.cast("struct<" + ",".join(f"{a}:string" for a in MASTER_FIELDS["articles"]) + ">"))
    resolved = resolved.select(
        *names[: names.index("invoice") + 1],
        first_text("client_name", "client_key").alias("client"),
        F.nullif(folded(F.coalesce(blank_to_null("client_name"), F.col("client_key"))), F.lit("")).alias("client_canonical"),
        period_of("date").alias("period"),
        week_of("date").alias("week"),
        "seller_key", "seller_name", "sales_scheme_key", "sales_scheme_name", "sales_force",
        *[blank_to_null(f"article.{a}").alias(a) for a in ARTICLE_ATTRIBUTES],
        "channel", "route_description",
        F.col("article").isNotNull().alias("has_article_match"),
        "has_seller_match",
    )
    dash = lambda c: F.coalesce(blank_to_null(c), F.lit("-"))
    return resolved.withColumn("has_route_match", F.col("route_description").isNotNull()).withColumn(
        "fact_key",
        F.concat_ws(
            "|", F.col("date").cast("string"), dash("client_key"), dash("invoice"), dash("product_key"),
            dash("seller_key"), F.coalesce("route_description", F.lit("Sin ruta")),
        ),
    )


def enrich_without_clients(sales: DataFrame, articles=None, routes=None, sellers=None) -> DataFrame:
    """Enrichment for single analyses: routes are matched by seller only, never by client."""
    plain = routes.withColumn("client_keys", F.lit(None).cast("array<string>")) if routes is not None else None
    return enrich(sales, articles, plain, sellers)
