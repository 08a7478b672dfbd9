"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CAUGHT: list[list[str]] = []


@contextmanager
def caught() -> Iterator[list[str]]:
    """The folders that are made meanwhile."""
    made: list[str] = []
    _CAUGHT.append(made)
    try:
        yield made
    finally:
        _CAUGHT.remove(made)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the one that the cluster shares (spark.checkpoint.dir). Where none is set, as in tests, a temporary one
    becomes it, but only if all of Spark runs on this machine; a cluster without a shared folder is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            root = "file://" + tempfile.mkdtemp(prefix="trackloom-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    folder = f"{root}/trackloom-{uuid.uuid4().hex}"
    for made in _CAUGHT:
        made.append(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and the work is done once."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Delete a staged table that nothing still to be run reads."""
    files = df.inputFiles()
    if files and files[0].rpartition("/")[0].rpartition("/")[2].startswith("trackloom-"):
        delete(df.sparkSession, files[0].rpartition("/")[0])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have (case is not told apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str, bool]:
    """The documents with a column that names each row, that column, and whether it was added: the id where all ids differ and none is null,
    else a number that is written with the rows."""
    if docs.select(F.col(id_col).alias("k")).groupBy("k").count().where("count > 1 OR k IS NULL").isEmpty():
        return docs, id_col, False
    name = fresh(docs, "row")
    return stage(docs.withColumn(name, F.monotonically_increasing_id())), name, True


def without(docs: DataFrame, key: str, gone: DataFrame, places: int = 1 << 18) -> DataFrame:
    """The documents whose ``key`` is not in ``gone`` (one column; no nulls). Keys are hashed to ``places``, and only documents in a place that
    holds a key to go are shuffled; the table of places is broadcast and has no more rows than that."""
    name, spot = fresh(docs, "gone_key"), fresh(docs, "gone_place")
    gone = gone.select(F.col(gone.columns[0]).alias(name))
    hit = F.broadcast(stage(gone.select(F.pmod(F.xxhash64(name), F.lit(places)).alias(spot)).distinct()))
    place = F.pmod(F.xxhash64(docs[key]), F.lit(places))
    return docs.join(hit, place == hit[spot], "left_anti").unionByName(docs.join(hit, place == hit[spot], "left_semi").join(gone, F.col(key) == gone[name], "left_anti"))


def parts_of(spark: SparkSession, units: float, each: float) -> int:
    """Partitions so that each gets about ``each`` units of work, however much there is; not fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8, -(-int(units) // int(each)))


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of a few megabytes, as texts may be long: the session's limits are lowered, never raised."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = int(re.sub(r"\D", "", spark.conf.get(key, None) or "0"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", limit: int = 4_000_000) -> DataFrame:
    """Whole rows through ``fn``, which drops some or changes values; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column, 4096, limit):
            yield fn(piece)
        pa.default_memory_pool().release_unused()  # the worker lives on

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece has few rows and few bytes in ``column`` (a longer row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        begin, held = 0, 0
        for i, n in enumerate(size):
            if i > begin and (held + n > limit or i - begin >= rows):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, column: str = "text", rows: int = 512, limit: int = 4_000_000) -> DataFrame:
    """``mapInArrow`` over slices; ``fn`` returns columns by name, or None for no rows."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    types = [(name, kinds[kind]) for name, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column, rows, limit):
            out = fn(piece)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=t) for n, t in types], schema=pa.schema(types))
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply), so that hashes are even in every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
