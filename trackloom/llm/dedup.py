"""Exact deduplication as a stream with disk-backed keyed state.

Documents arrive as a stream of (key, stable identifier, content locator). A streaming aggregation keeps, without
expiry, one state row per digest in RocksDB: how many arrived, the largest identifier, and the locator of that one's
content. Its map-side partial sums make a third of all rows with one digest a few rows per task. On hits (digests that
came more than once) the bytes behind the locators are compared in full before rows count as copies.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, fresh, keyed, shared_dir, stage, without

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # small stores don't reserve megabytes each, and a batch uploads what changed
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # all stores of an executor share a bounded memory, however many partitions it holds
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
}

#: Places that digests are hashed to, to sieve hits: the most rows of a table that is broadcast.
PLACES = 1 << 18
#: Only these letters fold.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Text with A-Z lowered and nothing else; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


@contextmanager
def _rocks(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_state(arrivals: DataFrame, checkpoint: str) -> DataFrame:
    """Drain the stream ``arrivals`` (digest, doc_id, locator) through the keyed state and return the latest state per
    digest: digest, keep_id, keep_locator, group_size. The checkpoint folder holds offsets and state: a restarted query
    goes on where it stopped, and later arrivals meet everything seen before."""
    spark = arrivals.sparkSession
    updates = f"{checkpoint}/updates"
    kept = arrivals.groupBy("digest").agg(
        F.count("*").alias("group_size"), F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("rank"), "doc_id", "locator")).alias("last")
    ).select("digest", F.col("last.doc_id").alias("keep_id"), F.col("last.locator").alias("keep_locator"), "group_size")
    with _rocks(spark):
        query = (
            kept.writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True)
            # a batch that is run again after a failure overwrites its own folder
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{updates}/batch={n}"))
            .start()
        )
        query.awaitTermination()
    out = spark.read.schema(f"digest string, keep_id {dict(arrivals.dtypes)['doc_id']}, keep_locator long, group_size long, batch long").parquet(updates)
    latest = out.groupBy("digest").agg(F.max_by(F.struct("keep_id", "keep_locator", "group_size"), "batch").alias("x"))
    return latest.select("digest", "x.*")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept, locator.

    Texts are equal when identical after lowering A-Z; null is empty. The row with the largest id stays (a null id is
    below all others; of rows that share that id, one stays). ``digest`` maps the normalised text to the state's key;
    texts that share a digest and differ are told apart. ``row_col`` names a column of whole numbers, all different, that
    locates each row in ``docs``; without it the locator is the row's place among the arrivals. An empty table gives an empty result."""
    spark, root = docs.sparkSession, shared_dir(docs.sparkSession)
    located = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    named = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"), located.alias("locator"))
    place = F.pmod(F.xxhash64("text"), F.lit(PLACES)).cast("int")
    landed = named.select("doc_id", digest(F.col("text")).alias("digest"), "locator", place.alias("place"))
    landed.write.parquet(f"{root}/arrivals")  # a locator of the arrivals is fixed once it is written
    state = stage(run_state(spark.readStream.schema(landed.schema).parquet(f"{root}/arrivals"), root))
    for done in ("updates", "query"):  # this stream has ended for good; run_state alone leaves them for the next arrivals
        delete(spark, f"{root}/{done}")
    rows = spark.read.schema(landed.schema).parquet(f"{root}/arrivals").join(state, "digest")
    out = rows.select("doc_id", "digest", "keep_id", "group_size", (F.col("locator") == F.col("keep_locator")).alias("kept"), "locator")
    # full bytes of all hits, compared within their digest; a large group meets as one row per task. Only what lies in a place of some hit is digested again and shuffled
    often = state.where("group_size > 1").select("digest")
    places = stage(rows.where("group_size > 1").select(F.col("place").alias("spot")).distinct())
    sieved = named.join(F.broadcast(places), place == F.col("spot"), "left_semi").withColumn("digest", digest(F.col("text")))
    hits = sieved.join(often, "digest", "left_semi")
    clashes = stage(hits.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest"))
    if clashes.isEmpty():
        return out
    apart = stage(hits.join(clashes, "digest", "left_semi"))
    rank = F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "locator")
    groups = apart.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max_by(F.struct("doc_id", "locator"), rank).alias("last"))
    parted = apart.join(groups, ["digest", "text"]).select("doc_id", "digest", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("last.locator")).alias("kept"), "locator")
    return out.join(clashes, "digest", "left_anti").select(parted.columns).unionByName(parted)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without exact copies, all columns as they are (whatever their names); of equal texts the row with the largest id stays. Ids may repeat
    or be null, which is below all others: rows are located by numbers then, and of equal texts with equal ids one stays. An empty table gives an empty result."""
    rows, key, added = keyed(docs, id_col)
    found = exact_dedup(rows, id_col, text_col, row_col=key if added else None).where("NOT kept")
    kept = without(rows, key, stage(found.select("locator" if added else "doc_id")))
    return kept.drop(key) if added else kept
