"""Helpers that the corpus operators share: staged tables, salted joins, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    spark.conf.set(SETTING, "file://" + tempfile.mkdtemp(prefix="cuelake-"))
    return spark.conf.get(SETTING)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/cuelake/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and executors may go."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove a staged table that no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "32m") -> None:
    """Bound what one Arrow batch holds, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_or_empty(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def join_by_unique(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left", counted: str | None = None) -> DataFrame:
    """Join rows to a table with one row a key when a key may hold a third of the rows.

    Keys that hold at least a 2000th of the rows (so 2000 at most) get as many salts as their share of
    the shuffle partitions; only their single right row is repeated. The other keys join unsalted.
    spread: a column that differs between the rows of a key. counted: a column of right that says how many left rows its key has,
    where that is known already.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = right.select(key, F.col(counted).alias("count")) if counted else left.groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = {r[0]: 2 + 2 * r[1] * parts // total for r in counts.where(F.col("count") >= max(64, total // 2000)).collect() if r[0] is not None}
    if not hot:
        return left.join(right, key, how)
    salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col(key)), F.lit(1)) if len(hot) < 200 else None
    if salts is None:
        table = spark.createDataFrame(list(hot.items()), left.select(key).schema.add("__n", T.IntegerType()))
        left = left.join(F.broadcast(table), key, "left")
        right = right.join(F.broadcast(table), key, "left")
        salts = F.coalesce(F.col("__n"), F.lit(1))
    left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1))).drop("__n")
    return left.join(right, [key, "__salt"], how).drop("__salt", "__n")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is the least node reachable.

    Alternating large-star and small-star rounds, each a grouped minimum and a join that splits hubs, staged
    so that a lost executor repeats one round at most. A round's tables go once the next one stands.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame) -> DataFrame:
        least = staged(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        old.append(least)
        return join_by_unique(pairs, least, "u", F.col("v"), "inner", counted="n").drop("n")

    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
            return nodes.groupBy("node").agg(F.min("component").alias("component"))
        seen, old = now, [e]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(star(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large-star")
        pulled = star(large)
        small = pulled.select(F.col("u"), F.col("m").alias("v")).unionByName(pulled.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        e = staged(small, "edges")
        for done in [*old, large]:
            unstage(done)
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
