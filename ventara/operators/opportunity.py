"""Sales opportunities per client, seller and channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ventara.functions.numbers import dbl, ratio
from ventara.operators.core import client_id, one_row, ranked
from ventara.plans.period import Period

COLUMNS = ("type", "name", "owner", "segment", "potential", "families")

# Types of opportunity.
BELOW_BENCHMARK = "Cliente bajo benchmark"
SHORT_MIX = "Cliente con mix corto"
LOW_PRODUCTIVITY = "Vendedor con baja productividad"
CHANNEL_POTENTIAL = "Canal con potencial"


def _exact(c):
    return F.col(c).cast("decimal(38,6)")


def force_benchmark(clients: DataFrame) -> DataFrame:
    """Mean sales of the buying clients per sales force."""
    buying = clients.filter(F.col("sales") > 0)
    return buying.groupBy("sales_force").agg((dbl(F.sum(_exact("sales"))) / F.count("*")).alias("benchmark"))


def client_opportunities(clients: DataFrame) -> DataFrame:
    """Active clients under 60 % of their force's benchmark, and active clients that buy one family or none.

    Both kinds come from one pass over the clients; a client can be listed under both.
    """
    sales, benchmark = F.col("sales"), F.coalesce("benchmark", F.lit(0.0))
    kind = lambda name, potential: F.struct(F.lit(name).alias("type"), potential.alias("potential"))
    found = F.array(
        F.when((benchmark > 0) & (sales < benchmark * 0.6), kind(BELOW_BENCHMARK, F.greatest(benchmark - sales, F.lit(0.0)) * 0.35)),
        F.when((F.col("families") <= 1) & (sales > 0), kind(SHORT_MIX, sales * 0.18)),
    )
    active = clients.filter(F.col("status") == "Activo").join(force_benchmark(clients), "sales_force", "left")
    rows = active.select(
        F.col("client").alias("name"), F.col("seller_name").alias("owner"), F.col("sales_force").alias("segment"), "families",
        F.inline_outer(F.filter(found, lambda x: x.isNotNull())))
    return rows.filter(F.col("type").isNotNull()).select(*COLUMNS)


def low_productivity(dimensions: DataFrame) -> DataFrame:
    """Sellers with at least 25 clients and under 65 % of the mean sales per client."""
    sellers = dimensions.filter(F.col("dimension") == "seller_name")
    cents = F.round("avg_sales_per_client", 2).cast("decimal(28,2)")
    mean = one_row(sellers, (dbl(F.sum(cents)) / F.count("*")).alias("m")).m
    own = dbl(cents)
    rows = sellers.filter((F.col("label") != "Sin vendedor") & (F.col("sales") > 0) & (F.col("clients") >= 25) & (own < mean * 0.65))
    return rows.select(
        F.lit(LOW_PRODUCTIVITY).alias("type"), F.col("label").alias("name"), F.lit("").alias("owner"), F.lit("Vendedor").alias("segment"),
        ((mean - own) * F.col("clients") * 0.25).alias("potential"), F.lit(0).cast("long").alias("families"),
    )


def channel_potential(fact: DataFrame, period: Period, dimensions: DataFrame) -> DataFrame:
    """Channels with more than 10 clients and under 75 % of the overall sales per client."""
    cur = fact.filter(period.in_selected())
    overall = one_row(cur, ratio(F.coalesce(F.sum("amount"), F.lit(0)), F.count_distinct(client_id())).alias("a")).a
    own = dbl(F.round("avg_sales_per_client", 2).cast("decimal(28,2)"))
    rows = dimensions.filter(
        (F.col("dimension") == "channel") & (F.col("label") != "Sin canal") & (F.col("clients") > 10) & (own < overall * 0.75))
    return rows.select(
        F.lit(CHANNEL_POTENTIAL).alias("type"), F.col("label").alias("name"), F.lit("").alias("owner"), F.lit("Canal").alias("segment"),
        ((overall - own) * F.col("clients") * 0.2).alias("potential"), F.lit(0).cast("long").alias("families"),
    )


def all_opportunities(fact: DataFrame, period: Period, clients: DataFrame, dimensions: DataFrame) -> DataFrame:
    frames = [client_opportunities(clients), low_productivity(dimensions), channel_potential(fact, period, dimensions)]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def prioritised(opportunities: DataFrame, n: int = 80) -> DataFrame:
    """The n largest opportunities."""
    return ranked(opportunities, n, [F.desc("potential"), "type", "name"])


def opportunities_summary(opportunities: DataFrame, top: int = 30) -> DataFrame:
    """Counts per kind and the potential of the largest ones."""
    is_type = lambda *t: F.count_if(F.col("type").isin(*t))
    best = ranked(opportunities, top, [F.desc("potential"), "type", "name"])
    cents = F.round("potential", 2).cast("decimal(28,2)")
    return opportunities.agg(
        F.count("*").alias("opportunities"), is_type(BELOW_BENCHMARK, SHORT_MIX).alias("client_opportunities"),
        is_type(BELOW_BENCHMARK).alias("below_benchmark"), is_type(SHORT_MIX).alias("short_mix"),
        is_type(LOW_PRODUCTIVITY).alias("seller_opportunities"), is_type(CHANNEL_POTENTIAL).alias("channel_opportunities"),
    ).withColumn("total_potential", one_row(best, dbl(F.coalesce(F.sum(cents), F.lit(0))).alias("p")).p)


def opportunities_alerts(summary: DataFrame) -> DataFrame:
    rules = [
        ("potencial accionable", F.col("total_potential") > 0, F.col("total_potential")),
        ("clientes con oportunidad", F.col("client_opportunities") >= 25, dbl("client_opportunities")),
        ("canales bajo promedio", F.col("channel_opportunities") >= 2, dbl("channel_opportunities")),
    ]
    structs = F.array(*[F.when(fires, F.struct(F.lit("opportunities").alias("board"), F.lit("warn").alias("severity"), F.lit(t).alias("topic"), v.alias("value"))) for t, fires, v in rules])
    return summary.select(F.inline_outer(F.filter(structs, lambda x: x.isNotNull()))).filter(F.col("topic").isNotNull())
