"""The sales fact over the test tables, as a DataFrame and as portable SQL for the oracles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ventara.plans.period import MonthWindow, Period
from ventara.operators.core import sales_grain
from ventara.plans.session import configure, kept

PERIOD = Period(date(2001, 5, 1), date(2001, 7, 31), date(2001, 1, 29), date(2001, 4, 30))
MONTH = MonthWindow(date(2001, 7, 20))
SUPPLIER = "Supplier#000000007"
#: Suppliers are broadcast when they were counted to be at most so many: 100 bytes each, where a shuffle would move every line once more.
BROADCAST_SUPPLIERS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, as it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched sales fact. Joins are left to the optimizer, which broadcasts only tables it knows to be small; suppliers are counted.

    Orders get their client and lines their article before both meet, so that neither is shuffled with the columns of the other. They
    meet by invoice, last: what is grouped by invoice after that needs no further shuffle. Labels of an article are made from its name and key
    before it meets the lines, so that these are not shuffled in their place.
    """
    configure(spark)
    read = lambda name: table(spark, sf_dir, name)
    orders = (
        read("orders")
        .join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("o_invoice", F.col("o_orderkey").cast("string"))
    )
    suppliers = read("supplier")
    if suppliers.count() <= BROADCAST_SUPPLIERS:
        suppliers = F.broadcast(suppliers)
    listed = F.col("p_partkey") % 13 != 0
    articles = read("part").withColumns({
        "family": F.when(listed, F.col("p_type")), "brand": F.when(listed, F.col("p_brand")), "business_unit": F.when(listed, F.split("p_name", " ")[0]),
    })
    lines = (
        read("lineitem")
        .join(articles, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("l_invoice", F.col("l_orderkey").cast("string"))
        .join(orders, F.col("l_invoice") == F.col("o_invoice"))
    )
    day = F.col("o_orderdate").cast("date")
    price = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    amount = price.cast("decimal(18,4)")
    taxes = (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,6)")
    route = F.when(F.col("o_custkey") % 11 != 0, F.concat_ws("/", "n_name", "c_mktsegment"))
    base = lines.select(
        day.alias("date"),
        F.date_format(day, "yyyy-MM").alias("period"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.col("o_custkey").cast("string").alias("client_key"),
        F.col("c_name").alias("client_name"),
        F.col("c_name").alias("client"),
        F.lower("c_name").alias("client_canonical"),
        F.col("l_invoice").alias("invoice"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").cast("string").alias("product_key"),
        F.col("p_name").alias("product_name"),
        "family",
        F.when(listed, F.split("p_name", " ")[1]).alias("line"),
        "brand",
        "business_unit",
        F.when(listed, F.col("p_size").cast("string")).alias("caliber"),
        F.col("s_name").alias("supplier"),
        F.col("c_mktsegment").alias("channel"),
        F.col("n_nationkey").cast("string").alias("seller_key"),
        F.col("n_name").alias("seller_name"),
        F.col("r_name").alias("sales_force"),
        F.col("o_orderpriority").alias("sales_scheme_name"),
        route.alias("route_description"),
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
        amount.alias("amount"),
        amount.alias("amount_net"),
        taxes.alias("internal_taxes"),
        (amount + taxes).alias("amount_final"),
        (amount + taxes).alias("amount_net_internal"),
        (F.col("l_quantity").cast("decimal(18,2)") * F.col("p_retailprice").cast("decimal(18,2)")).cast("decimal(18,4)").alias("cost"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), -1).otherwise(1).alias("sign"),
    )
    return base.select(
        "*",
        F.col("family").isNotNull().alias("has_article_match"),
        F.col("route_description").isNotNull().alias("has_route_match"),
        F.lit(True).alias("has_seller_match"),
        F.concat_ws(
            "|", F.col("date").cast("string"), "client_key", "invoice", "product_key", "seller_key",
            F.coalesce("route_description", F.lit("-")),
        ).alias("fact_key"),
    )


FACT_SQL = """
SELECT f.*, family IS NOT NULL AS has_article_match, route_description IS NOT NULL AS has_route_match,
       TRUE AS has_seller_match,
       concat_ws('|', CAST(date AS VARCHAR), client_key, invoice, product_key, seller_key,
                 coalesce(route_description, '-')) AS fact_key,
       coalesce(family, 'Sin familia') AS family_l, coalesce(brand, 'Sin marca') AS brand_l,
       coalesce(line, 'Sin línea') AS line_l, coalesce(business_unit, 'Sin unidad de negocio') AS bu_l,
       coalesce(route_description, 'Sin ruta') AS route_l
FROM (
  SELECT CAST(o.o_orderdate AS DATE) AS date,
         substr(CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR), 1, 7) AS period,
         year(o.o_orderdate) AS year, month(o.o_orderdate) AS month,
         CAST(o.o_custkey AS VARCHAR) AS client_key, c.c_name AS client_name, c.c_name AS client,
         lower(c.c_name) AS client_canonical,
         CAST(l.l_orderkey AS VARCHAR) AS invoice, l.l_linenumber AS line_no,
         CAST(l.l_partkey AS VARCHAR) AS product_key, p.p_name AS product_name,
         CASE WHEN l.l_partkey % 13 <> 0 THEN p.p_type END AS family,
         CASE WHEN l.l_partkey % 13 <> 0 THEN split_part(p.p_name, ' ', 2) END AS line,
         CASE WHEN l.l_partkey % 13 <> 0 THEN p.p_brand END AS brand,
         CASE WHEN l.l_partkey % 13 <> 0 THEN split_part(p.p_name, ' ', 1) END AS business_unit,
         CASE WHEN l.l_partkey % 13 <> 0 THEN CAST(p.p_size AS VARCHAR) END AS caliber,
         s.s_name AS supplier, c.c_mktsegment AS channel,
         CAST(n.n_nationkey AS VARCHAR) AS seller_key, n.n_name AS seller_name, r.r_name AS sales_force,
         o.o_orderpriority AS sales_scheme_name,
         CASE WHEN o.o_custkey % 11 <> 0 THEN n.n_name || '/' || c.c_mktsegment END AS route_description,
         CAST(l.l_quantity AS DECIMAL(18,2)) AS quantity,
         a.amount, a.amount AS amount_net, a.taxes AS internal_taxes,
         a.amount + a.taxes AS amount_final, a.amount + a.taxes AS amount_net_internal,
         CAST(CAST(l.l_quantity AS DECIMAL(18,2)) * CAST(p.p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS cost,
         CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN -1 ELSE 1 END AS sign
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey,
  LATERAL (SELECT CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS amount,
                  CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
                       * CAST(l.l_tax AS DECIMAL(4,2)) AS DECIMAL(18,6)) AS taxes) a
) f
"""

# Date predicates of the fixed periods, for the oracles.
CUR = "date BETWEEN DATE '2001-05-01' AND DATE '2001-07-31'"
PREV = "date BETWEEN DATE '2001-01-29' AND DATE '2001-04-30'"
SEEN = "date <= DATE '2001-07-31'"
MTD = "date BETWEEN DATE '2001-07-01' AND DATE '2001-07-20'"
MTD_PREV = "date BETWEEN DATE '2001-06-01' AND DATE '2001-06-20'"
MONTH_PREV = "date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30'"
MTD_YEAR_AGO = "date BETWEEN DATE '2000-07-01' AND DATE '2000-07-20'"


def with_fact(body: str, *ctes: str) -> str:
    """Oracle text: the fact as a CTE, optional further CTEs, then the query."""
    parts = ["fact AS (" + FACT_SQL + ")", *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def report(df: DataFrame) -> DataFrame:
    """Plain column types for comparison: dates as text, decimals as double, whole numbers as bigint."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        c = F.col(f"`{field.name}`")
        if kind == "date":
            c = c.cast("string")
        elif kind == "decimal":
            c = c.cast("double")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("long")
        columns.append(c.alias(field.name))
    return df.select(*columns)


class Checks:
    """Collects queries and their oracles."""

    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def add(self, name: str, oracle: str | None = None, on_fact: bool = True, rounded: tuple = (), once: bool | dict = False):
        """`rounded` names ratios whose last bits depend on summation order; both sides compare 6 decimals.

        With `once` the query gets the kept sales grain in place of the fact, for queries that read it several times; a dict names the
        labels and identities that they read.
        """
        if oracle and rounded:
            replaced = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in rounded)
            oracle = f"SELECT * REPLACE ({replaced}) FROM ({oracle})"

        def register(build):
            def run(spark, sf_dir):
                configure(spark)
                df = report(build(kept(sales_grain(fact(spark, sf_dir), **(once if isinstance(once, dict) else {}))) if once else fact(spark, sf_dir)) if on_fact else build(spark, sf_dir))
                return df.withColumns({c: F.round(c, 6) for c in rounded}) if rounded else df

            run.__name__ = name
            run.__doc__ = build.__doc__
            self.queries[name] = run
            if oracle:
                self.oracles[name] = oracle
            return build

        return register
