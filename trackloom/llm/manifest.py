"""Merkle manifest of a dataset: a digest for each row, a root over all of them, and for each row the siblings that prove it is under the root.

A tree's nodes stand in runs of ``FAN``, and each run's digests, joined, are hashed to its parent. Nodes are grouped into aligned blocks, whose runs never cross
a block's end. A block keeps each of its levels as one string of hexadecimal digests, 64 characters each: substrings of fixed width give the runs to
hash, and those that flank a node within its run are the node's siblings. A block's top is a node of the next round, so the roots recurse: first by
language, then over the languages. On the way back a block hands its own node's siblings, further up, to the nodes below it.

A node's place is its rank, from range partitions sorted within and the sums of what comes before them, so no language needs to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Nodes of a run, characters of a digest, and nodes of a block: a power of ``FAN``.
FAN, WIDTH, BLOCK = 2, 64, 256
#: Rows of which this number divides the check sum of the id are tampered with by the audit.
TAMPERED = 7


def digest(text: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of a string."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value so that neighbours can't run together: bytes of its text, a colon, the text; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with their ``place`` from 0 within ``group`` (never null) by ``order`` (nulls first), and the group's ``size``. Rows are range-sorted, so a group lies in as many
    partitions as its size needs; counts by partition and group, some more rows than there are of both, give what comes before."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie")
    local = stage(dealt.withColumn("dealt", F.spark_partition_id()).withColumn("run", F.monotonically_increasing_id()))
    counts = local.groupBy("dealt", group).agg(F.count("*").alias("n"), F.min("run").alias("first"))
    ahead = Window.partitionBy(group).orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("dealt", group, (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("base"), F.sum("n").over(Window.partitionBy(group)).alias("size"))
    return local.join(base, ["dealt", group]).select(*rows.columns, (F.col("run") + F.col("base")).alias("place"), "size")


def _parents(level: Column, fan: int) -> Column:
    """The level above: each run of ``fan`` digests, the last one as long as it is, hashed."""
    runs = F.ceil(F.length(level) / F.lit(WIDTH * fan)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), runs), lambda i: digest(F.substring(level, (i - 1) * WIDTH * fan + 1, F.lit(WIDTH * fan)))), "")


def _levels(level: Column, fan: int, block: int, alone: Column) -> Column:
    """A block's levels from its nodes up to its top. Blocks that have neighbours rise as high as a full one, a lone node too; one that is ``alone`` ends at one node."""
    high, n = 0, 1
    while n < block:
        high, n = high + 1, n * fan
    rise = lambda held, _: F.when(alone & (F.length(F.element_at(held, -1)) <= WIDTH), held).otherwise(F.concat(held, F.array(_parents(F.element_at(held, -1), fan))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(high)), F.array(level), rise)


def _siblings(levels: Column, at: Column, fan: int) -> Column:
    """left, right by level: what flanks the node above place ``at`` within its run, on each level below the top."""

    def flank(level: Column, high: Column) -> Column:
        node = F.floor(at / F.pow(F.lit(float(fan)), high)).cast("int")
        run = node - F.pmod(node, F.lit(fan))
        return F.struct(F.substring(level, run * WIDTH + 1, (node - run) * WIDTH).alias("left"), F.substring(level, (node + 1) * WIDTH + 1, (run + fan - node - 1) * WIDTH).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), flank)


def fold(node: Column, path: Column) -> Column:
    """The root that a digest gives with its siblings."""
    return F.aggregate(path, node, lambda held, x: digest(F.concat(x["left"], held, x["right"])))


_KEPT = "struct<doc_id:bigint,leaf:string,tampered:string>"


def blocks_of(nodes: DataFrame, fan: int, block: int) -> DataFrame:
    """Nodes (group, size, place, digest, kept) by block, which is a node above: group, size, place, digest (the block's top), levels, nodes."""
    rows = nodes.groupBy("group", "size", F.floor(F.col("place") / block).alias("up")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "kept"))).alias("nodes"))
    level = F.array_join(F.transform("nodes", lambda x: x["digest"]), "")
    out = rows.withColumn("levels", _levels(level, fan, block, F.col("size") <= block))
    pairs = F.transform("nodes", lambda x: F.struct(x["place"].alias("place"), x["kept"].alias("kept")))
    return out.select("group", F.ceil(F.col("size") / block).alias("size"), F.col("up").alias("place"), F.element_at("levels", -1).alias("digest"), "levels", pairs.alias("nodes"))


def rise(nodes: DataFrame, fan: int, block: int) -> list[DataFrame]:
    """Rounds of blocks of the nodes (group, size, place, digest, kept), lowest first; the last one has a block for each group, with its root."""
    most, rounds = nodes.agg(F.max("size")).first()[0] or 0, []
    while True:
        rounds.append(stage(blocks_of(nodes, fan, block)))
        most = -(-most // block)
        if most <= 1:
            return rounds
        nodes = rounds[-1].select("group", "size", "place", "digest", F.lit(None).cast(_KEPT).alias("kept"))


def descend(rounds: list[DataFrame], above: DataFrame | None, fan: int, block: int) -> DataFrame:
    """group, place, digest of the node, kept, path (left, right by level, up to the last root) and roots (nearest first) of all nodes below the lowest round. ``above``: what the
    groups' roots have got as nodes of another tree (group, path, roots)."""
    top = rounds[-1]
    if above is None:
        held = top.select("*", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.array("digest").alias("roots"))
    else:
        held = top.join(above.select("group", "path", F.col("roots").alias("upper")), "group").select(*top.columns, "path", F.concat(F.array("digest"), "upper").alias("roots"))
    for k in range(len(rounds) - 1, -1, -1):
        own = F.transform("nodes", lambda x: F.struct(x["place"].alias("place"), x["kept"].alias("kept"), F.concat(_siblings(F.col("levels"), F.pmod(x["place"], F.lit(block)), fan), F.col("path")).alias("path")))
        nodes = held.select("group", "roots", F.explode(own).alias("x")).select("group", "roots", "x.*")
        if k == 0:
            return nodes
        below = rounds[k - 1]
        held = below.join(nodes.drop("kept"), ["group", "place"])


def prove(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), audit: str | None = "n_chars", fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot (of its ``group_col``), root, path (left and right siblings from the leaf up), folded_root, verified.

    A leaf is the digest of the row's ``columns``, and rows of a group stand by id, then by leaf. To show what the manifest finds, the audit folds rows of which ``TAMPERED``
    divides the check sum of the decimal id with one more in column ``audit`` (None: no row); a null there stays, and so does a row without an id.

    Nulls in any column are fields of their own, distinct from empty ones; rows without an id come first, and rows without a group are one group, before all others. Repeated rows are
    leaves of their own, next to each other. An empty table gives an empty result."""
    held = 1
    while held < block:
        held *= fan
    if held != block or fan < 2:
        raise ValueError("a block must be a power of the fan")
    own = [F.col(c) for c in columns]
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit("-")).alias("group"), F.col(id_col).cast("long").alias("doc_id"), leaf_digest(own).alias("leaf"), _tampered(columns, id_col, audit).alias("tampered"))
    leaves = ranked(rows, "group", ["doc_id", "leaf"]).select("group", "size", "place", F.col("leaf").alias("digest"), F.struct("doc_id", "leaf", "tampered").alias("kept"))
    low = rise(leaves, fan, block)
    tops = ranked(low[-1].select(F.lit("").alias("all"), "group", "digest"), "all", ["group"])
    # a group's root is a leaf of the upper tree; its name rides along
    high = rise(tops.select(F.col("all").alias("group"), "size", "place", "digest", F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("group").alias("leaf"), F.lit(None).cast("string").alias("tampered")).alias("kept")), fan, block)
    above = descend(high, None, fan, block).select(F.col("kept.leaf").alias("group"), "path", "roots")
    out = descend(low, above, fan, block).select("kept.*", "path", "roots")
    out = out.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path"))).withColumn("root", F.get("roots", F.lit(1)))
    return out.select("doc_id", "leaf", F.get("roots", F.lit(0)).alias("subroot"), "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tampered(columns: tuple[str, ...], id_col: str, audit: str | None) -> Column:
    """The leaf of a row that the audit changes, else null."""
    if audit is None:
        return F.lit(None).cast("string")
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % TAMPERED == 0
    more = [(F.col(c).cast("decimal(38,0)") + 1).cast("decimal(38,0)") if c == audit else F.col(c) for c in columns]
    return F.when(hit & F.col(audit).isNotNull(), leaf_digest(more))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def manifest(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``prove`` with the proof as a digest: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    out = prove(docs, **options)
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
