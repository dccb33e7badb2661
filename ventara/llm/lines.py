"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

A line's key is the line without white space at both ends (space and U+0009 to U+000D) and with A-Z lower-cased. Keys of at
least MIN_LENGTH code points that occur in two documents or more lose all their lines but those of the smallest document id.

Documents are taken in batches of rising id. The keys of all batches are hashed once (MD5) and stored by batch. Each batch
reduces its lines to one row per key, merge-anti-joins the runs stored so far, and writes the keys it finds new as a run of its own:
a table bucketed and sorted by hash, so that the runs are never shuffled for a join. Once FANOUT runs stand on one level they are
compacted into one run of the next. Because ids rise from batch to batch, a key that a run holds already belongs to a smaller id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventara.llm.base import Scratch, free_name

#: Shortest key that counts, batches of documents, and runs of a level that are compacted into one.
MIN_LENGTH, BATCHES, FANOUT = 10, 4, 2

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """The key of a line. lower() does the same as the translation where all is ASCII, and faster."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class Runs:
    """The stored runs, as bucketed tables of the session's catalog in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.prefix = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _table(self, keys: DataFrame) -> str:
        """Rows arrive dealt by hash into as many partitions as there are buckets, so each bucket is one sorted file."""
        name = f"{self.prefix}_{self.made}"
        self.made += 1
        keys.write.option("compression", "zstd").partitionBy("seen").bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(name)
        return name

    def all(self) -> list[DataFrame]:
        return [self._run(name) for level in self.levels for name in level]

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where(~F.col("seen")).select("hash")

    def add(self, keys: DataFrame) -> DataFrame:
        """Store the keys of a batch, marked where a run holds them already; the others are a run of the lowest level."""
        for k, run in enumerate(self.all()):
            keys = keys.join(run.withColumn(f"in{k}", F.lit(True)), "hash", "left")
        marks = [F.col(c) for c in keys.columns if c.startswith("in")]
        name = self._table(keys.select("hash", "owner", "last", F.coalesce(*marks, F.lit(False)).alias("seen")))
        self.levels[0].append(name)
        return self.spark.table(name)

    def compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                merged = None
                for name in self.levels[k]:
                    run = self._run(name)
                    merged = run if merged is None else merged.union(run)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._table(merged.repartition(self.buckets, "hash").withColumn("seen", F.lit(False))))
                for name in self.levels[k]:
                    self.spark.sql(f"DROP TABLE {name}")
                self.levels[k] = []

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")


def dropped_lines(df: DataFrame, id_column: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(id, sig, pos): the line numbers, from 0, that go from the rows with this id and text hash. Rows without id lose nothing."""
    spark = df.sparkSession
    scratch = Scratch(spark, "lines")
    rows = df.select(df[id_column].alias("id"), df[text].alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    edges = rows.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000).alias("edges")).first()["edges"] or []
    batch = sum((F.when(F.col("id") > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    lines = rows.select("id", F.xxhash64("text").alias("sig"), batch.alias("batch"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = scratch.write(lines.select("batch", "id", "sig", "pos", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= min_length).select("batch", "id", "sig", "pos", F.unhex(F.md5("key")).alias("hash")), "keyed")
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    out = []
    for k in range(len(edges) + 1):
        own = keyed.where(F.col("batch") == k)
        judged = runs.add(own.groupBy("hash").agg(F.min("id").alias("owner"), F.max("id").alias("last")))
        # keys with lines to drop: all lines where a run held the key before, else those outside the owner
        shared = scratch.write(judged.where(F.col("seen") | (F.col("owner") != F.col("last"))).select("hash", F.when(~F.col("seen"), F.col("owner")).alias("owner")), f"shared-{k}")
        gone = own.join(shared, "hash").where(F.col("owner").isNull() | (F.col("owner") != F.col("id"))).select("id", "sig", "pos")
        out.append(scratch.write(gone, f"gone-{k}"))
        scratch.drop(f"shared-{k}")
        if k < len(edges):
            runs.compact()
    runs.close()
    scratch.drop("keyed")
    merged = out[0]
    for part in out[1:]:
        merged = merged.union(part)
    return merged


def dedup(df: DataFrame, id_column: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """All columns of df, and behind them `_lines` (with underscores added while df has it): struct<n_lines, n_dropped, kept>.

    Null and empty texts are one empty line that stays (kept is the empty text). Lines that repeat inside the owner stay. Rows with
    the same id count as one document; identical rows keep the same lines. Rows without id are left as they are and own no key.
    """
    gone = dropped_lines(df, id_column, text, **settings)
    cuts = gone.groupBy("id", "sig").agg(F.array_sort(F.collect_set("pos")).alias("_cuts"))  # the lines of one document at most
    # the pieces between dropped lines, so that the work is linear in the lines
    lines, cut = F.col("_split"), F.col("_cuts")
    edges = F.concat(F.array(F.lit(-1)), cut, F.array(F.size(lines)))
    kept = F.when(cut.isNull(), lines).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(1), F.size(cut) + 1), lambda k: F.slice(lines, F.element_at(edges, k) + 2, F.element_at(edges, k + 1) - F.element_at(edges, k) - 1)))
    )
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), df[id_column].alias("id"), F.xxhash64(df[text]).alias("sig"), df[text].alias("text"))
    joined = packed.join(cuts, ["id", "sig"], "left").select("row", "_cuts", split_lines(F.col("text")).alias("_split"))
    return joined.select("row.*", F.struct(F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(F.size(cut), F.lit(0)).cast("bigint").alias("n_dropped"), F.array_join(kept, "\n").alias("kept")).alias(free_name(df, "_lines")))
