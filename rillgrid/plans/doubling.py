"""Aggregates along the paths of a forest in a logarithmic number of rounds.

A forest is a table with an ``id`` and ``down``, the id of the next node or null at a path's end. Each
round doubles the length of path that a node's state covers, so a path of a million nodes takes
twenty rounds, each a join or two on the id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CycleError
from . import tables

Combine = Callable[[Column, Column], Column]


def _rounds(n: int) -> int:
    return max(1, n).bit_length() + 1


def _run(forest: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = forest.sparkSession
    work = tables.folder(spark)
    state = tables.write(forest.withColumnRenamed("down", "__jump"), f"{work}/0")
    n = state.count()
    for k in range(1, _rounds(n) + 2):
        if state.where("__jump is not null").isEmpty():
            return state.drop("__jump")
        state = tables.write(step(state), f"{work}/{k}")
        tables.drop(spark, f"{work}/{k - 1}")
    raise CycleError("the flow graph has a cycle")


def downstream(forest: DataFrame, combine: dict[str, Combine]) -> DataFrame:
    """Each column folded over the node and all nodes down its path.

    ``combine[c](near, far)`` joins what is near to what is farther down; it must be associative.
    """
    names = [c for c in forest.columns if c not in ("id", "down", *combine)]

    def step(state: DataFrame) -> DataFrame:
        far = state.select(F.col("id").alias("__at"), F.col("__jump").alias("__next"), *(F.col(c).alias(f"__{c}") for c in combine))
        joined = state.join(far, state["__jump"] == far["__at"], "left")
        folded = [F.when(F.col("__at").isNotNull(), f(F.col(c), F.col(f"__{c}"))).otherwise(F.col(c)).alias(c) for c, f in combine.items()]
        return joined.select("id", *names, *folded, F.col("__next").alias("__jump"))

    return _run(forest, step)


def upstream(forest: DataFrame, combine: dict[str, tuple[Callable[[Column], Column], Combine]], moments: tuple[str, ...] = ()) -> DataFrame:
    """Each column folded over the node and all nodes whose paths lead to it.

    ``combine[c]`` is an aggregate and the same operation on two columns: (F.sum, a + b) or (F.max, greatest). For each m of
    ``moments`` the columns m_n, m_mean and m_m2 (count, mean, sum of squared distances from it) are merged by the formula
    of Chan, Golub and LeVeque, which doesn't cancel.
    """
    parts = [f"{m}_{p}" for m in moments for p in ("n", "mean", "m2")]
    names = [c for c in forest.columns if c not in ("id", "down", *combine, *parts)]

    def merged(m: str) -> list[Column]:
        n, mean, m2 = (F.col(f"{m}_{p}") for p in ("n", "mean", "m2"))
        far_n, far_mean, far_m2 = (F.coalesce(F.col(f"__{m}_{p}"), F.lit(0)) for p in ("n", "mean", "m2"))
        total, apart = n + far_n, F.col(f"__{m}_mean") - mean
        middle = F.when(n == 0, F.col(f"__{m}_mean")).when(far_n == 0, mean).otherwise(mean + apart * far_n / total)
        spread = m2 + far_m2 + F.when((n > 0) & (far_n > 0), apart * apart * n * far_n / total).otherwise(0.0)
        return [total.alias(f"{m}_n"), middle.alias(f"{m}_mean"), spread.alias(f"{m}_m2")]

    def step(state: DataFrame) -> DataFrame:
        going, to = state.where("__jump is not null"), Window.partitionBy("__jump")
        for m in moments:  # the mean of all that go to one node, to which their squares are then referred
            total = F.sum(f"{m}_n").over(to)
            going = going.withColumn(f"__{m}_all", F.when(total > 0, F.sum(F.col(f"{m}_n") * F.col(f"{m}_mean")).over(to) / total))
        sums = [agg(c).alias(f"__{c}") for c, (agg, _) in combine.items()]
        for m in moments:
            apart = F.col(f"{m}_mean") - F.col(f"__{m}_all")
            sums += [F.sum(f"{m}_n").alias(f"__{m}_n"), F.max(f"__{m}_all").alias(f"__{m}_mean"), F.sum(F.col(f"{m}_m2") + F.coalesce(F.col(f"{m}_n") * apart * apart, F.lit(0.0))).alias(f"__{m}_m2")]
        sent = going.groupBy(F.col("__jump").alias("__to")).agg(*sums)
        far = state.select(F.col("id").alias("__at"), F.col("__jump").alias("__next"))
        joined = state.join(sent, state["id"] == sent["__to"], "left").join(far, state["__jump"] == far["__at"], "left")
        folded = [F.when(F.col("__to").isNotNull(), f(F.col(c), F.col(f"__{c}"))).otherwise(F.col(c)).alias(c) for c, (_, f) in combine.items()]
        folded += [c for m in moments for c in merged(m)]
        return joined.select("id", *names, *folded, F.col("__next").alias("__jump"))

    return _run(forest, step)


SUM = (F.sum, lambda a, b: a + b)
MAX = (F.max, lambda a, b: F.greatest(a, b))
MIN = (F.min, lambda a, b: F.least(a, b))


def last(near: Column, far: Column) -> Column:
    """The value farthest down the path that isn't null."""
    return F.coalesce(far, near)


def first(near: Column, far: Column) -> Column:
    """The nearest value down the path that isn't null."""
    return F.coalesce(near, far)


def both(near: Column, far: Column) -> Column:
    return near & far


def either(near: Column, far: Column) -> Column:
    return near | far


def closure(forest: DataFrame) -> DataFrame:
    """``(id, descendant)``: every node with itself and all nodes down its path. For tables of segments, not of cells."""
    spark = forest.sparkSession
    work = tables.folder(spark)
    pairs = tables.write(forest.select("id", F.col("id").alias("descendant"), F.lit(0).alias("d")), f"{work}/p0")
    jumps = tables.write(forest.select("id", "down"), f"{work}/j0")
    n = jumps.count()
    for k in range(1, _rounds(n) + 2):
        links = jumps.where("down is not null")
        if links.isEmpty():
            return pairs.select("id", "descendant")
        far = pairs.select(F.col("id").alias("__at"), "descendant", "d")
        more = links.join(far, links["down"] == far["__at"]).select("id", "descendant", (F.col("d") + (1 << (k - 1))).alias("d"))
        pairs = tables.write(pairs.unionByName(more), f"{work}/p{k}")
        next_ = jumps.select(F.col("id").alias("__at"), F.col("down").alias("__next"))
        jumps = tables.write(links.join(next_, links["down"] == next_["__at"], "left").select("id", F.col("__next").alias("down")), f"{work}/j{k}")
    raise CycleError("the flow graph has a cycle")
