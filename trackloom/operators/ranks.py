"""Numbering that needs no group, and not the whole table, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.joins import roots
from trackloom.sources.scratch import settled


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``name``: the place from 0 within ``group`` (none: among all rows) by ``order``, nulls first; ties in any order. Rows are range-sorted by both, each task numbers its own
    stretch, and what comes before a stretch is summed over one row for each partition and group."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    local = settled(dealt.withColumns({"_part": F.spark_partition_id(), "_run": F.monotonically_increasing_id()}))
    counts = local.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_run").alias("_first"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group], (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_base"))
    same = [F.col("_part") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]]
    return local.join(base, same).select(*rows.columns, (F.col("_run") + F.col("_base")).alias(name))


def preorder(nodes: DataFrame, node: str, parent: str, order: str, kept: str | None = None) -> DataFrame:
    """Trees as lists: ``root``, ``depth``, and ``place`` from 0 within the tree of nodes, each before its children, children by ``order`` (then by node). Only nodes that ``kept``
    (an SQL condition) holds for are listed and numbered; the children of others stay. A node whose parent is null or no node is a root.

    A node's path of order keys is put together by doubling: after k rounds it reaches 2**k links up, so rounds grow with the logarithm of the depth. Lists are numbered by
    ranges of paths, so a tree with very many nodes lies in many tasks. Nodes in circles have no root: they are left out."""
    step = F.struct(F.col(order).alias("order"), F.col(node).alias("node"))
    links = nodes.select(F.col(node).alias("_node"), F.col(parent).alias("_up")).join(nodes.select(F.col(node).alias("_known")), F.col("_up") == F.col("_known"), "left_semi")
    # a chain that leads into a circle ends, by ``roots``, at a node that has a parent itself
    ends = roots(links, "_node", "_up")
    circular = ends.join(links.select(F.col("_node").alias("_child")), F.col("root") == F.col("_child"), "left_semi").select(F.col("node").alias("_lost"))
    now = nodes.select(F.col(node).alias("_node"), F.array(step).alias("_path")).join(circular, F.col("_node") == F.col("_lost"), "left_anti")
    now = now.join(links.select(F.col("_node").alias("_child"), "_up"), F.col("_node") == F.col("_child"), "left").select("_node", "_path", "_up")
    while True:
        now = settled(now)
        if now.where("_up IS NOT NULL").isEmpty():
            break
        above = now.select(F.col("_node").alias("_at"), F.col("_path").alias("_before"), F.col("_up").alias("_next"))
        now = now.join(above, F.col("_up") == F.col("_at"), "left").select("_node", F.concat(F.coalesce("_before", F.array().cast(dict(now.dtypes)["_path"])), "_path").alias("_path"), F.col("_next").alias("_up"))
    rows = nodes.join(now.select("_node", "_path"), F.col(node) == F.col("_node")).drop("_node")
    rows = rows if kept is None else rows.where(kept)
    rows = rows.withColumns({"root": F.get("_path", F.lit(0))["node"], "depth": F.size("_path") - 1})
    return numbered(rows, ["root"], ["_path"]).drop("_path")


def running(rows: DataFrame, group: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """``name``: the sum of ``value`` (null counts as 0) over the rows of ``group`` that come before by ``order`` (no ties), by the same ranges: sums within a stretch, and of stretches."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    local = settled(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.col(value), F.lit(0)).cast("long")
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy("_part", *group).agg(F.sum(n).alias("_n"))
    base = sums.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    same = [F.col("_part") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]]
    told = local.withColumn("_own", F.coalesce(F.sum(n).over(own), F.lit(0)))
    return told.join(base, same).select(*rows.columns, (F.col("_own") + F.col("_base")).alias(name))
