"""Join-shaped operators. Sides are joined by shuffle unless the optimizer sees that one is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.sources.scratch import settled


def fill_counts(rows: DataFrame, counted: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """``name``: how many rows of ``counted`` have the key, 0 where none."""
    n = counted.groupBy(F.col(right).alias("_key")).agg(F.count("*").alias(name))
    return rows.join(n, F.col(left) == F.col("_key"), "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long"))).drop("_key")


def append_unseen(first: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """All of ``first``, and of ``later`` the rows whose key is not in it; null keys are always kept."""
    return first.unionByName(later.join(first.select(key).distinct(), key, "left_anti").select(first.columns))


def covering_run(points: DataFrame, runs: DataFrame, key: str, at: str, begins: str, values: list[str]) -> DataFrame:
    """Each point with the last run of its key that begins at or before it (nulls where none does). One shuffle: both sides are put in order
    and the last run seen is carried on, so a key's runs are never multiplied with its points."""
    missing = [F.lit(None).cast(dict(runs.dtypes)[v]).alias(v) for v in values]
    extra = [c for c in points.columns if c not in (key, at)]
    left = points.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), *extra, F.lit(None).cast(dict(runs.dtypes)[begins]).alias(begins), *missing)
    right = runs.select(key, F.col(begins).alias("_at"), F.lit(0).alias("_side"), *[F.lit(None).cast(dict(points.dtypes)[c]).alias(c) for c in extra], begins, *values)
    seen = Window.partitionBy(key).orderBy("_at", "_side", *[F.col(v) for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    run = F.last(F.when(F.col("_side") == 0, F.struct(begins, *values)), ignorenulls=True).over(seen)
    return left.unionByName(right).withColumn("_run", run).where("_side = 1").select(key, F.col("_at").alias(at), *extra, *[F.col("_run")[c].alias(c) for c in (begins, *values)])


def ratio_pairs(rows: DataFrame, keys: list[str], size: str, ratio: int, name: str) -> DataFrame:
    """Pairs within equal keys of which one's size is ``ratio`` times the other's: the size itself is a join key, so no pairs are tried."""
    small = rows.select(*keys, F.col(name).alias(f"{name}_small"), F.col(size).alias("_size"))
    large = rows.select(*keys, F.col(name).alias(f"{name}_large"), F.when(F.pmod(F.col(size), F.lit(ratio)) == 0, F.expr(f"{size} div {ratio}")).cast(dict(rows.dtypes)[size]).alias("_size"))
    return small.join(large, [*keys, "_size"]).select(*keys, f"{name}_small", f"{name}_large")


def reconcile(expected: DataFrame, found: DataFrame, key: str, left: str, right: str, status: Column) -> DataFrame:
    """Full outer join of two keyed tables (one row a key) with a status."""
    return expected.select(key, left).join(found.select(key, right), key, "full_outer").withColumn("status", status)


def roots(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """node, root: where every node's chain of parents ends, by doubling steps: after k rounds 2**k links are followed, so rounds grow with the logarithm of
    the longest chain. Nodes that lead into a circle end at its least node. ``edges`` has one parent a child."""
    now = edges.select(F.col(child).alias("node"), F.col(parent).alias("root"))
    tops = settled(edges.select(F.col(parent).alias("node")).join(now.select("node"), "node", "left_anti").distinct())
    now = now.unionByName(tops.select("node", F.col("node").alias("root"))).withColumn("least", F.least("node", "root"))
    left, steps = None, 1
    while True:
        now = settled(now)
        rest = now.join(tops.select(F.col("node").alias("_top")), F.col("root") == F.col("_top"), "left_anti").count()
        # each round brings some chain to its end; those that none brings on lead into circles, which hold no more nodes than are left
        if not rest or rest == left and steps >= rest:
            break
        left, steps = rest, steps * 2
        up = now.select(F.col("node").alias("_up"), F.col("root").alias("_root"), F.col("least").alias("_least"))
        now = now.join(up, F.col("root") == F.col("_up")).select("node", F.col("_root").alias("root"), F.least("least", "_least").alias("least"))
    ends = now.select(F.col("node").alias("_end"), F.col("least").alias("_least"))
    ends = ends.join(tops.select(F.col("node").alias("_top")), F.col("_end") == F.col("_top"), "left").select("_end", F.coalesce("_top", "_least").alias("_root"))
    return now.select("node", "root").join(ends, F.col("root") == F.col("_end")).select("node", F.col("_root").alias("root"))
