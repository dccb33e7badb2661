"""Direction board: the alerts of all dashboards in one prioritised list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ventara.functions.numbers import dbl, to_tenth
from ventara.operators.core import one_row, ranked

# Area, owner and scores (critical, otherwise) of each source of alerts.
SOURCES = {
    "budget": ("Presupuesto", "Dirección", 92, 72),
    "history": ("Histórico", "Dirección", 90, 66),
    "opportunities": ("Oportunidad", "Comercial", 86, 62),
    "sellers": ("Vendedores", "Jefatura ventas", 84, 60),
    "clients": ("Clientes", "Key accounts", 88, 64),
}
ROLE_SCORES = {"critical": 95, "good": 25, "warn": 70}

# Alerts in the order of their rules, with those words of their full texts that the action words below can meet.
SAID = {
    "role": (("Riesgo de cierre", "cierre objetivo"), ("Cierre controlado", "cierre objetivo"), ("Vendedor a corregir", ""), ("Ruta debilitada", "clientes"),
             ("Canal con baja rotación", "clientes"), ("Familia en retracción", ""), ("Clientes relevantes sin compra", "")),
    "budget": (("último mes bajo plan", "plan presupuesto"), ("acumulado bajo plan", "plan")),
    "history": (("caída mensual", ""), ("dependencia de clientes", "clientes"), ("concentración", "clientes")),
    "opportunities": (("potencial accionable", ""), ("clientes con oportunidad", "clientes"), ("canales bajo promedio", "canales cliente")),
    "sellers": (("dependencia", "vendedores"), ("vendedor en caída", "clientes"), ("cartera liviana", "vendedores")),
    "clients": (("concentración", ""), ("sin recompra", "clientes"), ("mix corto", "clientes"), ("cuenta en riesgo", "")),
}

# Words in an alert that give its action category; the first line that applies wins.
ACTION_WORDS = (
    (("cierre", "objetivo"), "plan de cierre"),
    (("presupuesto", "plan"), "ajuste de presupuesto"),
    (("cliente",), "recuperación de cartera"),
    (("canal",), "cobertura de canal"),
    (("vendedor",), "meta del responsable"),
)
DEFAULT_ACTION = "acción correctiva"


def _seed(df: DataFrame, board: str | None = None) -> DataFrame:
    columns = {c: F.col(c) for c in df.columns}
    label = columns.get("label", F.lit(None).cast("string"))
    critical = F.col("severity") == "critical"
    if board is None:
        score = F.when(critical, ROLE_SCORES["critical"]).when(F.col("severity") == "good", ROLE_SCORES["good"]).otherwise(ROLE_SCORES["warn"])
        area = owner = F.col("role")
        source = F.lit(0)
    else:
        name, who, high, low = SOURCES[board]
        score, area, owner = F.when(critical, high).otherwise(low), F.lit(name), F.lit(who)
        source = F.lit(1 + list(SOURCES).index(board))
    known = SAID[board or "role"]
    pick = lambda i, otherwise: F.coalesce(*[F.when(F.col("topic") == a[0], F.lit(k if i is None else a[i])) for k, a in enumerate(known)], F.lit(otherwise))
    return df.select(
        pick(None, len(known)).alias("rule"), pick(1, "").alias("said"), area.alias("area"), owner.alias("owner"), "topic", "severity", score.cast("long").alias("score"), dbl("value").alias("value"), label.alias("label"),
        source.cast("long").alias("source"))


def direction_board(role_alerts: DataFrame, by_board: dict[str, DataFrame], n: int = 6) -> DataFrame:
    """The n most urgent alerts with owner, priority and action category; good news is left out."""
    rows = _seed(role_alerts)
    for board in SOURCES:
        if board in by_board:
            rows = rows.unionByName(_seed(by_board[board], board))
    top = ranked(rows.filter(F.col("severity") != "good"), n, [F.desc("score"), "source", "rule", "topic"])
    text = F.lower(F.concat_ws(" ", "area", "topic", "said", "label"))
    action = F.lit(DEFAULT_ACTION)
    for words, name in reversed(ACTION_WORDS):
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        action = F.when(hit, name).otherwise(action)
    priority = F.when(F.col("severity") == "critical", "Alta").otherwise("Media")
    return top.select("rank", "area", "owner", "topic", "severity", "score", "value", "label", priority.alias("priority"), action.alias("action"))


def board_kpis(month: DataFrame, budget: DataFrame, owners: DataFrame, opportunities: DataFrame, clients: DataFrame, history: DataFrame) -> DataFrame:
    """Six indicators of the board from the one-row summaries of the dashboards."""
    pick = lambda df, c: one_row(df, F.max(dbl(c)).alias("v")).v
    row = month.sparkSession.range(1).select(
        pick(month, "projected_gap_pct").alias("close"), pick(budget, "last_gap_pct").alias("budget"), pick(owners, "gap_pct").alias("owners"),
        pick(opportunities, "total_potential").alias("potential"), pick(clients, "at_risk").alias("risk"), pick(history, "top10_clients_pct").alias("top10"),
    )
    close, top10 = to_tenth("close"), to_tenth("top10")
    cards = [
        ("Gap cierre mes", "close", F.when(close >= 0, "good").when(close >= -3, "warn").otherwise("bad")),
        ("Gap presupuesto", "budget", F.when(to_tenth("budget") >= 0, "good").otherwise("warn")),
        ("Gap responsables", "owners", F.when(to_tenth("owners") >= 0, "good").otherwise("warn")),
        ("Potencial accionable", "potential", F.lit("good")),
        ("Clientes en riesgo", "risk", F.when(F.col("risk") > 120, "bad").when(F.col("risk") > 60, "warn").otherwise("good")),
        ("Concentración top 10", "top10", F.when(top10 < 30, "good").when(top10 < 40, "warn").otherwise("bad")),
    ]
    structs = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(n).alias("label"), F.col(v).alias("value"), t.alias("tone")) for i, (n, v, t) in enumerate(cards, 1)])
    return row.select(F.inline_outer(structs))
