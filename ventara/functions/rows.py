"""Small literal tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple], types: dict[str, str] | None = None) -> DataFrame:
    """A table of fixed rows that stays inside the JVM plan."""
    types = types or {}

    def cell(name, value):
        c = F.lit(value)
        return (c.cast(types[name]) if name in types else c.cast("string") if value is None else c).alias(name)

    structs = [F.struct(*[cell(n, v) for n, v in zip(names, row)]) for row in rows]
    if not structs:
        return literal_rows(spark, names, [tuple(None for _ in names)], types).filter(F.lit(False))
    return spark.range(1).select(F.inline(F.array(*structs)))
