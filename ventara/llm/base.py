"""What the operators share: table reading, stored intermediate tables and text helpers."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach: spark.checkpoint.dir, else a folder of the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a result; Spark removes its files with the last reference where cleanCheckpoints is set.

    Not for loops: a checkpointed plan keeps the size estimates of the plan it replaces, which square with every join. Loops
    cut their lineage with Scratch.keep.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate Parquet tables of one operator run below the shared folder."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"

        self.made = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a frame under the next number and read it back."""
        self.made += 1
        return self.write(df, f"step-{self.made}")

    def _folder(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def empty(self, name: str) -> bool:
        """Whether a written folder holds nothing but the marks of its writer."""
        where, files = self._folder(name)
        return not any(x.getPath().getName()[0] not in "_." for x in files.listStatus(where))

    def drop(self, name: str = "") -> None:
        """Free a table, or all of them, that nothing refers to any more."""
        where, files = self._folder(name)
        files.delete(where, True)

    def drop_but(self, name: str) -> None:
        """Free all tables but one."""
        where, files = self._folder("")
        for x in files.listStatus(where):
            if x.getPath().getName() != name:
                files.delete(x.getPath(), True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added while df has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def bucket_of(id_column: str, modulus: int):
    """crc32 of the id as text, modulo a number; 0 for a missing id."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def map_values(df: DataFrame, keep: list[str], value: str, fields: list[tuple[str, str]], make, rows: int = 500) -> DataFrame:
    """The columns `keep` as they are, and new columns that make(list of values) returns as one list for each field.

    Arrow batches are cut into parts of at most `rows` rows; fields are (name, DDL type). Kept columns never leave Arrow.
    """
    picked = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[value].alias("v"))
    out = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField(n, T.DataType.fromDDL(t)) for n, t in fields])
    kinds, names, n = [to_arrow_type(f.dataType) for f in out.fields[len(keep) :]], out.names, len(keep)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = make(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=names)

    return picked.mapInArrow(run, out)
