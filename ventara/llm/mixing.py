"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of source, language and topic. The token weights of the cells are raked to the target share of each
value of each margin in turn, until no margin is off by more than TOLERANCE or ROUNDS rounds are done. A cell's factor is its raked weight
over its tokens; with the largest factor scaled to 1 it is the probability with which its documents are drawn, by a hash of their id.

There are as many cells as combinations occur. Up to CELLS of them are raked on the driver; more are raked by shuffles, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventara.llm.base import Scratch, free_name

MARGINS = ("source", "lang", "topic")

#: Exponent that tempers the observed share of each margin's values into a target (1: as observed, 0: all alike).
TEMPER = {"source": 0.85, "lang": 0.9, "topic": 0.95}
#: Largest part of all tokens by which a value may miss its target, and rounds after which raking ends in any case.
TOLERANCE = 1e-12
ROUNDS = 60

#: Cells that are raked on the driver and whose factors are broadcast; beyond that they are raked and joined by shuffle.
CELLS = 100_000


def tokens_of(text: Column) -> Column:
    """Words between white space (space and U+0009 to U+000D)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def topic_of(text: Column) -> Column:
    """A plain topic by what a text mentions: licences, addresses, figures, or none of these."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit("icense")), "legal").when(F.contains(text, F.lit("@")), "contact").when(F.regexp_like(text, F.lit("[0-9]")), "figures").otherwise("prose")


def draw_of(id_column: Column) -> Column:
    """A number in [0, 1) from the id: the first 32 bits of its MD5; rows of one id share it."""
    return F.conv(F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0


@dataclass
class Fit:
    """Factors (source, lang, topic, tokens, factor), the largest of them, and how well the margins are met.

    `residual`: per margin the largest part of all tokens by which a value misses its target. `unmet`: values with a target and no tokens;
    the other values share their part.
    """

    factors: DataFrame
    top: float
    cells: int
    rounds: int
    residual: dict[str, float]
    unmet: dict[str, list[str]]


def _shares(margin: str, values: np.ndarray, tokens: np.ndarray, targets: dict | None) -> tuple[np.ndarray, list[str]]:
    """Target shares of the values of a margin, and the values that have a target only. Values without tokens or target get 0."""
    if targets is None:
        power = np.where(tokens > 0, tokens ** TEMPER[margin], 0.0)
        unmet = []
    else:
        given = targets[margin]
        power = np.array([given.get(v, 0.0) if n > 0 else 0.0 for v, n in zip(values.tolist(), tokens.tolist(), strict=True)])
        unmet = sorted(v for v in given if v not in set(values[tokens > 0].tolist()) and given[v] > 0)
    return power / (power.sum() or 1.0), unmet


def rake(cells: list[tuple], targets: dict[str, dict[str, float]] | None = None) -> tuple[np.ndarray, int, dict[str, float], dict[str, list[str]]]:
    """Weights of cells (source, lang, topic, tokens), rounds, residual per margin and unmet values."""
    tokens = np.array([c[3] for c in cells], float)
    total, weight = tokens.sum(), tokens.copy()
    sides, unmet = [], {}
    for k, margin in enumerate(MARGINS):
        values, at = np.unique(np.array([c[k] for c in cells], object), return_inverse=True)
        shares, unmet[margin] = _shares(margin, values, np.bincount(at, tokens, len(values)), targets)
        sides.append((at, shares * total))
    rounds, residual = 0, {}
    while rounds < ROUNDS:
        rounds += 1
        for at, wanted in sides:
            held = np.bincount(at, weight, len(wanted))
            weight = weight * np.where(held > 0, wanted / np.where(held > 0, held, 1), 0.0)[at]
        residual = {m: float(np.abs(np.bincount(at, weight, len(wanted)) - wanted).max(initial=0.0) / (total or 1.0)) for m, (at, wanted) in zip(MARGINS, sides, strict=True)}
        if max(residual.values()) <= TOLERANCE:
            break
    return weight, rounds, residual, unmet


def rake_by_shuffle(cells: DataFrame, targets: dict[str, dict[str, float]] | None, scratch: Scratch) -> tuple[DataFrame, int, dict[str, float], dict[str, list[str]]]:
    """The same for a table of any number of cells: one table of targets and one join for each margin and round, each round written."""
    total = cells.agg(F.sum("tokens").cast("double").alias("n")).first()["n"] or 0.0
    wanted, unmet = {}, {}
    for m in MARGINS:
        seen = cells.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
        if targets is None:
            power, unmet[m] = seen.where("tokens > 0").select("value", F.pow("tokens", F.lit(TEMPER[m])).alias("power")), []
        else:
            given = cells.sparkSession.createDataFrame(list(targets[m].items()), "value string, power double")
            unmet[m] = sorted(r["value"] for r in given.where("power > 0").join(seen.where("tokens > 0"), "value", "left_anti").collect())  # of the targets that were given
            power = seen.where("tokens > 0").join(given, "value").select("value", "power")
        whole = power.agg(F.sum("power").alias("n")).first()["n"] or 1.0
        wanted[m] = scratch.keep(power.select(F.col("value").alias(m), (F.col("power") / whole * total).alias("_wanted")))
    held, rounds, residual = cells.withColumn("weight", F.col("tokens").cast("double")), 0, {}
    while rounds < ROUNDS:
        rounds += 1
        for m in MARGINS:
            sums = held.groupBy(m).agg(F.sum("weight").alias("_sum")).join(wanted[m], m, "left")
            change = sums.select(m, F.when(F.col("_sum") > 0, F.coalesce("_wanted", F.lit(0.0)) / F.col("_sum")).otherwise(0.0).alias("_change"))
            held = held.join(change, m).withColumn("weight", F.col("weight") * F.col("_change")).drop("_change")
        held = scratch.keep(held)
        for m in MARGINS:
            missed = held.groupBy(m).agg(F.sum("weight").alias("_sum")).join(wanted[m], m, "left")
            residual[m] = (missed.agg(F.max(F.abs(F.col("_sum") - F.coalesce("_wanted", F.lit(0.0)))).alias("r")).first()["r"] or 0.0) / (total or 1.0)
        if max(residual.values()) <= TOLERANCE:
            break
    return held, rounds, residual, unmet


def fit(packed: DataFrame, targets: dict[str, dict[str, float]] | None = None, most: int = CELLS) -> Fit:
    """Factors of the cells of (source, lang, topic, tokens) rows. `targets`: value -> share per margin, else observed shares are tempered."""
    spark, scratch = packed.sparkSession, Scratch(packed.sparkSession, "mixing")
    cells = scratch.write(packed.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    n = cells.count()
    schema = "source string, lang string, topic string, tokens long, factor double"
    if n <= most:
        rows = sorted((r["source"], r["lang"], r["topic"], r["tokens"]) for r in cells.collect())  # n is checked
        weight, rounds, residual, unmet = rake(rows, targets)
        told = [(*c, float(w / c[3]) if c[3] else None) for c, w in zip(rows, weight.tolist(), strict=True)]
        scratch.drop()
        return Fit(spark.createDataFrame(told, schema), max((x[4] for x in told if x[4] is not None), default=1.0), n, rounds, residual, unmet)
    raked, rounds, residual, unmet = rake_by_shuffle(cells, targets, scratch)
    factors = scratch.write(raked.select(*MARGINS, "tokens", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).alias("factor")), "factors")
    scratch.drop_but("factors")
    return Fit(factors, factors.agg(F.max("factor").alias("top")).first()["top"] or 1.0, n, rounds, residual, unmet)


def mixed(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, name: str = "_mix", most: int = CELLS) -> DataFrame:
    """All columns of df, and behind them `name` (with underscores added while df has it): struct<topic, tokens, factor, probability, sampled>.

    Missing sources and languages are values of their own (the empty text). A cell without tokens keeps probability 1: it weighs nothing.
    `targets` gives value -> share per margin, else the observed shares are tempered. Repeated rows are drawn together.
    """
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), df[id_column].alias("id"), F.coalesce(df[source].cast("string"), F.lit("")).alias("source"),
        F.coalesce(df[lang].cast("string"), F.lit("")).alias("lang"), (topic if topic is not None else topic_of(df[text])).alias("topic"), tokens_of(df[text]).alias("tokens"),
    )
    found = fit(packed, targets, most)
    sides = found.factors.select(*MARGINS, "factor", F.coalesce(F.col("factor") / F.lit(found.top or 1.0), F.lit(1.0)).alias("probability"))
    joined = packed.join(F.broadcast(sides) if found.cells <= most else sides, list(MARGINS))
    return joined.select("row.*", F.struct("topic", "tokens", "factor", "probability", (draw_of(F.col("id")) < F.col("probability")).alias("sampled")).alias(free_name(df, name)))


def oracle(iterations: int = 30) -> str:
    """DuckDB SQL for the query: the same raking, unrolled to more rounds than the tolerance takes."""
    steps = [
        """docs AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE WHEN contains(coalesce(text, ''), 'icense') THEN 'legal' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
              WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM documents
), cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM docs GROUP BY ALL)"""
    ]
    for name in MARGINS:
        steps.append(f"t_{name} AS (SELECT {name}, power(tokens, {TEMPER[name]}) / sum(power(tokens, {TEMPER[name]})) OVER () * (SELECT sum(tokens) FROM cells) AS target FROM (SELECT {name}, sum(tokens) AS tokens FROM cells GROUP BY 1 HAVING sum(tokens) > 0))")
    last, k = "(SELECT *, tokens AS weight FROM cells)", 0
    for _ in range(iterations):
        for name in MARGINS:
            k += 1
            steps.append(f"w{k} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, CASE WHEN c.s > 0 THEN c.weight * (coalesce(t.target, 0) / c.s) ELSE 0 END AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY {name}) AS s FROM {last}) c LEFT JOIN t_{name} t ON c.{name} = t.{name})")
            last = f"w{k}"
    steps.append(f"factors AS (SELECT source, lang, topic, coalesce(f / max(f) OVER (), 1.0) AS p, f FROM (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens END AS f FROM {last}))")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, topic, tokens, CAST(round(f * 1000000) AS BIGINT) AS factor_ppm, CAST(round(p * 1000000) AS BIGINT) AS probability_ppm,
       CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < p AS sampled
FROM docs JOIN factors USING (source, lang, topic)
"""
