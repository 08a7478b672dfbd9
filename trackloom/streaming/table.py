"""A keyed table that a stream is merged into, batch by batch: written as changes, merged when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructType


def upsert(changes: DataFrame, batch: int, path: str) -> None:
    """Add a batch of changes. A batch that is run again overwrites its own folder, so the table is the same however often that happens."""
    changes.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")


def upserting(changes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Merge a stream of changes (keys, an order, and columns; nulls leave a column as it is) into the table at ``path``."""
    return changes.writeStream.foreachBatch(lambda df, n: upsert(df, n, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose folder is complete, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [x.getPath() for x in fs.listStatus(root) if x.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, path: str, schema: StructType, key: str, order: str) -> DataFrame:
    """The table: of each key, per column the last value that is not null, by batch and then by ``order``; the key's last ``order`` stays with it. Reads the last compacted state and the changes
    after it. A change without a key is none; a table without batches is empty."""
    bases, parts = _folders(spark, f"{path}/state"), []
    if bases:
        parts.append(spark.read.schema(schema).parquet(f"{path}/state/batch={bases[-1]}").withColumn("_batch", F.lit(-1).cast("long")))
    later = [n for n in _folders(spark, f"{path}/changes") if not bases or n > bases[-1]]
    if later:
        read = spark.read.schema(StructType([*schema.fields]).add("batch", LongType())).option("basePath", f"{path}/changes")
        parts.append(read.parquet(*[f"{path}/changes/batch={n}" for n in later]).withColumnRenamed("batch", "_batch"))
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
    at = F.struct("_batch", order)
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in schema.names if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*latest).select(*schema.names)


def compact(spark: SparkSession, path: str, schema: StructType, key: str, order: str) -> None:
    """Write the table as the state up to its last batch. Readers take the old state until the new one is complete; running it again changes nothing."""
    done = _folders(spark, f"{path}/changes")
    if done and done[-1] not in _folders(spark, f"{path}/state"):
        current(spark, path, schema, key, order).write.mode("overwrite").parquet(f"{path}/state/batch={done[-1]}")
