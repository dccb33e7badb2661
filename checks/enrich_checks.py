"""Queries for the enrichment joins, with masters derived from the test tables."""

from pyspark.sql import functions as F

from checks.fixtures import Checks, table
from ventara.operators import enrich as ops

C = Checks()


def raw_sales(spark, sf_dir):
    """Sales lines with gaps: blank seller keys, operational route codes, force names in the route field."""
    orders = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.col("o_orderkey") % 5
    return lines.select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_custkey").cast("string").alias("client_key"),
        F.when(F.col("o_custkey") % 9 == 0, "").otherwise(F.concat(F.lit("  Ñandú "), "c_name")).alias("client_name"),
        F.when(kind == 0, F.concat(F.lit("0000 - "), F.col("n_nationkey")))
        .when(kind == 1, F.upper("r_name")).when(kind == 2, F.concat(F.lit("ruta "), F.lower("n_name")))
        .when(kind == 3, "").otherwise(F.concat_ws("/", "n_name", "c_mktsegment")).alias("route_description"),
        F.when(F.col("o_custkey") % 7 == 0, "").otherwise(F.col("n_nationkey").cast("string")).alias("seller_key"),
        F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise("").alias("seller_name"),
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("n_regionkey").cast("string")).alias("sales_scheme_key"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("sales_scheme_name"),
        F.col("l_partkey").cast("string").alias("product_key"),
        F.col("l_orderkey").cast("string").alias("invoice"),
        F.col("c_mktsegment").alias("channel"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("amount"),
        F.col("l_quantity").cast("decimal(18,4)").alias("quantity"),
    )


def articles(spark, sf_dir):
    part = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 13 != 0)
    return part.select(
        F.col("p_partkey").cast("string").alias("product_key"), F.col("p_type").alias("family"),
        F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("caliber"), F.col("p_partkey").alias("load_seq"),
    )


def sellers(spark, sf_dir):
    """Several rows per nation; the one loaded last wins."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.when(F.col("n_nationkey") % 6 != 0, F.col("n_nationkey").cast("string")).otherwise("").alias("seller_key"),
            F.concat("n_name", F.when(F.col("s_suppkey") % 3 == 0, " B").otherwise("")).alias("seller_name"),
            F.concat(F.lit("Ruta  "), F.upper("n_name")).alias("route_description"),
            F.col("r_name").alias("sales_force"),
            F.col("s_suppkey").alias("load_seq"),
        )
    )


def routes(spark, sf_dir):
    """Active routes per nation, segment and block of clients; expired ones per region and segment."""
    clients = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("block", F.floor(F.col("c_custkey") / 500))
    )
    listed = F.collect_list(F.col("c_custkey").cast("string"))
    active = clients.filter(F.col("c_custkey") % 5 != 0).groupBy("n_name", "n_nationkey", "r_name", "n_regionkey", "c_mktsegment", "block").agg(listed.alias("client_keys"))
    expired = clients.filter(F.col("c_custkey") % 10 != 0).groupBy("r_name", "n_regionkey", "c_mktsegment", "block").agg(listed.alias("client_keys"))
    shape = [
        "route_description", "seller_key", "seller_name", "sales_force", "branch_name", "sales_scheme_key",
        "is_active", "valid_from", "valid_to", "client_keys", "client_count", "load_seq",
    ]
    one = active.select(
        F.concat("n_name", F.lit("/"), "c_mktsegment", F.lit("/"), F.col("block")).alias("route_description"),
        F.col("n_nationkey").cast("string").alias("seller_key"), F.col("n_name").alias("seller_name"),
        F.col("r_name").alias("sales_force"), F.concat(F.lit("Sucursal "), "r_name").alias("branch_name"),
        F.col("n_regionkey").cast("string").alias("sales_scheme_key"), F.lit(True).alias("is_active"),
        F.lit("2001-01-01").alias("valid_from"), F.lit("2099-12-31").alias("valid_to"), "client_keys",
        F.size("client_keys").cast("long").alias("client_count"), (F.col("block") * 1000 + F.col("n_nationkey") * 5 + F.length("c_mktsegment")).alias("load_seq"),
    )
    two = expired.select(
        F.concat(F.lit("000-"), "c_mktsegment", F.col("block")).alias("route_description"),
        F.lit("").alias("seller_key"), F.lit("").alias("seller_name"),
        F.col("r_name").alias("sales_force"), F.concat(F.lit("Sucursal "), "r_name").alias("branch_name"),
        F.lit("").alias("sales_scheme_key"), F.lit(False).alias("is_active"),
        F.lit("1995-01-01").alias("valid_from"), F.lit("1999-12-31").alias("valid_to"), "client_keys",
        F.size("client_keys").cast("long").alias("client_count"), (F.col("block") * 1000 + F.length("c_mktsegment")).alias("load_seq"),
    )
    return one.select(*shape).unionByName(two.select(*shape))


OUT = (
    "date", "client_key", "client", "client_canonical", "period", "week", "seller_key", "seller_name", "sales_scheme_key",
    "sales_scheme_name", "sales_force", "family", "brand", "caliber", "channel", "route_description", "invoice", "product_key",
    "has_article_match", "has_route_match", "has_seller_match", "fact_key",
)

FOLD = "trim(regexp_replace(translate(lower(trim({0})), 'áéíóúüñ', 'aeiouun'), '\\s+', ' ', 'g'))"

ENRICH_SQL = f"""
WITH sales AS (
  SELECT row_number() OVER () AS id, CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS VARCHAR) AS client_key,
    CASE WHEN o_custkey % 9 = 0 THEN '' ELSE '  Ñandú ' || c_name END AS client_name,
    CASE o_orderkey % 5 WHEN 0 THEN '0000 - ' || n_nationkey WHEN 1 THEN upper(r_name) WHEN 2 THEN 'ruta ' || lower(n_name) WHEN 3 THEN ''
      ELSE n_name || '/' || c_mktsegment END AS raw_route,
    CASE WHEN o_custkey % 7 = 0 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END AS seller_key,
    CASE WHEN o_custkey % 4 = 0 THEN ' ' || lower(n_name) ELSE '' END AS seller_raw,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS scheme_key,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS scheme_name,
    CAST(l_partkey AS VARCHAR) AS product_key, CAST(l_orderkey AS VARCHAR) AS invoice, c_mktsegment AS channel
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sellers AS (
  SELECT CASE WHEN n_nationkey % 6 <> 0 THEN CAST(n_nationkey AS VARCHAR) ELSE '' END AS sk,
    n_name || CASE WHEN s_suppkey % 3 = 0 THEN ' B' ELSE '' END AS sn, 'Ruta  ' || upper(n_name) AS sr, r_name AS sf, s_suppkey AS seq
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s_key AS (SELECT * FROM sellers WHERE sk <> '' QUALIFY row_number() OVER (PARTITION BY sk ORDER BY seq DESC) = 1),
s_route AS (SELECT {FOLD.format('sr')} AS k, * FROM sellers QUALIFY row_number() OVER (PARTITION BY {FOLD.format('sr')} ORDER BY seq DESC) = 1),
s_name AS (SELECT {FOLD.format('sn')} AS k, * FROM sellers QUALIFY row_number() OVER (PARTITION BY {FOLD.format('sn')} ORDER BY seq DESC) = 1),
cust AS (SELECT *, CAST(floor(c_custkey / 500) AS BIGINT) AS block FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
routes AS (
  SELECT n_name || '/' || c_mktsegment || '/' || block AS rd, CAST(n_nationkey AS VARCHAR) AS sk, n_name AS sn, r_name AS sf, 'Sucursal ' || r_name AS bn,
    CAST(n_regionkey AS VARCHAR) AS scheme, 1 AS active, '2001-01-01' AS vf, '2099-12-31' AS vt, list(CAST(c_custkey AS VARCHAR)) AS cks, count(*) AS cc,
    block * 1000 + n_nationkey * 5 + length(c_mktsegment) AS seq FROM cust WHERE c_custkey % 5 <> 0 GROUP BY n_name, n_nationkey, r_name, n_regionkey, c_mktsegment, block
  UNION ALL
  SELECT '000-' || c_mktsegment || block, '', '', r_name, 'Sucursal ' || r_name, '', 0, '1995-01-01', '1999-12-31', list(CAST(c_custkey AS VARCHAR)), count(*),
    block * 1000 + length(c_mktsegment) FROM cust WHERE c_custkey % 10 <> 0 GROUP BY r_name, n_regionkey, c_mktsegment, block),
r_seller AS (SELECT {FOLD.format('sn')} AS k, * FROM routes WHERE sn <> ''
  QUALIFY row_number() OVER (PARTITION BY {FOLD.format('sn')} ORDER BY active DESC, vt DESC, vf DESC, cc DESC, seq DESC, rd DESC) = 1),
rc AS (SELECT unnest(cks) AS client, * FROM routes),
r_client AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY client ORDER BY active DESC, vt DESC, vf DESC, cc DESC, seq DESC, rd DESC) = 1),
r_pair AS (SELECT * FROM rc WHERE scheme <> '' QUALIFY row_number() OVER (PARTITION BY client, scheme ORDER BY active DESC, vt DESC, vf DESC, cc DESC, seq DESC, rd DESC) = 1),
units AS (SELECT DISTINCT {FOLD.format('bn')} AS k FROM routes UNION SELECT DISTINCT {FOLD.format('sf')} FROM routes),
m AS (
  SELECT s.*, coalesce(a.sn, b.sn, c.sn) AS m_sn, coalesce(a.sr, b.sr, c.sr) AS m_sr, coalesce(a.sf, b.sf, c.sf) AS m_sf,
    coalesce(a.sn, b.sn, c.sn) IS NOT NULL AS m_found
  FROM sales s LEFT JOIN s_key a ON a.sk = s.seller_key LEFT JOIN s_route b ON b.k = {FOLD.format('s.raw_route')} LEFT JOIN s_name c ON c.k = {FOLD.format('s.seller_raw')}),
n AS (SELECT *, coalesce(nullif(trim(m_sn), ''), nullif(trim(seller_raw), ''), nullif(seller_key, '')) AS s0 FROM m),
r AS (
  SELECT n.*, coalesce(p.rd, q.rd) AS c_rd, coalesce(p.sk, q.sk) AS c_sk, coalesce(p.sn, q.sn) AS c_sn, coalesce(p.sf, q.sf) AS c_sf,
    CASE WHEN p.rd IS NOT NULL THEN (p.active, p.vt, p.vf, p.cc) WHEN q.rd IS NOT NULL THEN (q.active, q.vt, q.vf, q.cc) END AS c_rank,
    x.rd AS x_rd, x.sf AS x_sf, CASE WHEN x.rd IS NOT NULL THEN (x.active, x.vt, x.vf, x.cc) END AS x_rank
  FROM n LEFT JOIN r_seller x ON x.k = {FOLD.format('n.s0')}
  LEFT JOIN r_pair p ON p.client = n.client_key AND p.scheme = nullif(n.scheme_key, '') LEFT JOIN r_client q ON q.client = n.client_key),
t AS (SELECT *, CASE WHEN c_rd IS NOT NULL AND (x_rd IS NULL OR c_rank >= x_rank) THEN c_rd ELSE x_rd END AS rt,
    CASE WHEN c_rd IS NOT NULL AND (x_rd IS NULL OR c_rank >= x_rank) THEN c_sf ELSE x_sf END AS rt_sf,
    CASE WHEN c_sn <> '' THEN c_sn ELSE s0 END AS seller_f, CASE WHEN c_sn <> '' THEN coalesce(nullif(c_sk, ''), nullif(seller_key, '')) ELSE nullif(seller_key, '') END AS key_f FROM r),
u AS (SELECT *, coalesce(CASE WHEN replace(rt, ' ', '') NOT LIKE '0000-%' AND replace(rt, ' ', '') NOT LIKE '000-%' THEN rt END,
      CASE WHEN replace(m_sr, ' ', '') NOT LIKE '0000-%' AND replace(m_sr, ' ', '') NOT LIKE '000-%' THEN nullif(trim(m_sr), '') END) AS fm,
    CASE WHEN replace(raw_route, ' ', '') NOT LIKE '0000-%' AND replace(raw_route, ' ', '') NOT LIKE '000-%' THEN nullif(trim(raw_route), '') END AS own FROM t),
v AS (SELECT u.*, CASE WHEN units.k IS NOT NULL THEN fm ELSE coalesce(fm, own) END AS route_f FROM u LEFT JOIN units ON units.k = {FOLD.format('coalesce(u.fm, u.own)')})
SELECT CAST(date AS VARCHAR) AS date, client_key, coalesce(nullif(trim(client_name), ''), client_key) AS client,
  {FOLD.format("CASE WHEN trim(client_name) = '' THEN client_key ELSE client_name END")} AS client_canonical,
  strftime(date, '%Y-%m') AS period, strftime(date, '%G-W%V') AS week, key_f AS seller_key, seller_f AS seller_name, nullif(scheme_key, '') AS sales_scheme_key,
  coalesce(nullif(scheme_name, ''), rt_sf) AS sales_scheme_name, coalesce(nullif(scheme_name, ''), rt_sf, m_sf) AS sales_force,
  p_type AS family, p_brand AS brand, CAST(p_size AS VARCHAR) AS caliber, channel, route_f AS route_description, invoice, product_key,
  p_partkey IS NOT NULL AS has_article_match, route_f IS NOT NULL AS has_route_match, (m_found OR key_f IS NOT NULL OR trim(seller_raw) <> '') AS has_seller_match,
  concat_ws('|', CAST(date AS VARCHAR), client_key, invoice, product_key, coalesce(key_f, '-'), coalesce(route_f, 'Sin ruta')) AS fact_key
FROM v LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = product_key AND p_partkey % 13 <> 0
"""


@C.add("enrich", ENRICH_SQL, on_fact=False)
def enrich(spark, sf_dir):
    return ops.enrich(raw_sales(spark, sf_dir), articles(spark, sf_dir), routes(spark, sf_dir), sellers(spark, sf_dir)).select(*OUT)


@C.add("enrich_without_clients", ENRICH_SQL.replace("rc AS (SELECT unnest(cks) AS client, * FROM routes)", "rc AS (SELECT unnest(cks) AS client, * FROM routes WHERE FALSE)"), on_fact=False)
def enrich_without_clients(spark, sf_dir):
    return ops.enrich_without_clients(
        raw_sales(spark, sf_dir), articles(spark, sf_dir), routes(spark, sf_dir), sellers(spark, sf_dir)).select(*OUT)
