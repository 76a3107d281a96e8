"""Shared folder, written tables, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, the folder that all executors share.

    Where the setting is absent a temporary folder stands in, in local mode only: a cluster
    without a shared folder is an error, since a machine-local one dies with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="rillgrid-"))
    path = f"{root.rstrip('/')}/rillgrid-{uuid.uuid4().hex}"
    if path.startswith("/"):
        path = f"file://{path}" if spark.sparkContext.master.startswith("local") else path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def integer(name: str) -> Column:
    """A column of ids as bigint; null where a value is no integer."""
    return F.expr(f"try_cast(`{name}` as bigint)")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df``, written as Parquet and read again.

    This cuts the lineage, survives the loss of any executor, and gives the planner the true
    size of the table, so that joins to it are broadcast only when it is small.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, work: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as ``(node, root)``, root the least node.

    Alternates the large-star and small-star steps (Kiveris et al. 2014), which end after a
    number of rounds logarithmic in the longest path, and never gather a component in a task.
    A self edge names a node, which is its own root if no other edge has it; null ends are dropped. An empty table gives no rows.
    """
    spark = edges.sparkSession
    alone = written(edges.where("a = b").select("a", "b").distinct(), f"{work}/alone")
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null").distinct()
    table = written(pairs, f"{work}/cc0")
    previous = None
    for step in range(1, max_rounds + 1):
        both = table.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(table.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u goes to the least of u's neighbourhood
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        path = f"{work}/cc{step}"
        table = written(small, path)
        state = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        remove(spark, f"{work}/cc{step - 1}")
        if previous == state:
            break
        previous = state
    else:
        raise RuntimeError("components did not settle")
    roots = table.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = roots.unionByName(table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    alone = alone.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots if alone.isEmpty() else roots.unionByName(alone.join(roots, "node", "left_anti"))
