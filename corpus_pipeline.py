"""A corpus pipeline over ``documents``: each stage works on what the one before kept, and all but the last return whole documents.

The stages, in order: documents in no learned language go; exact copies go; of each class of near duplicates one document stays;
secrets are masked; what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import dedup, jaccard, langid, packing, secret_scan
from trackloom.llm.common import caught, delete, fresh, keyed, release, stage, without

#: Least share of the letters that a document's language has; four languages alike would give each a quarter.
LEAST_SHARE = 0.3

#: Folders that steps called outside of ``run`` left, by step.
_direct: dict[str, list[str]] = {}


def _step(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[..., DataFrame]:
    """A step that keeps account of the tables it writes on the way in ``left`` (by step). Those of the step before it in ``STAGES`` go when it begins, unless ``docs`` still reads
    them: a step's result is to be written before the next step is called. Nothing else is deleted, so results of other runs, and of the last step, stay readable."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str, left: dict[str, list[str]] | None = None) -> DataFrame:
        left = _direct if left is None else left
        names = [name for name, _ in STAGES]
        before = dict(zip(names[1:], names, strict=False)).get(fn.__name__)
        if folders := left.pop(before, None):
            read = docs.inputFiles()
            for folder in folders:
                name = folder.rpartition("/")[2]
                if not any(name in f for f in read):
                    delete(spark, folder)
        with caught() as made:
            out = fn(spark, docs, sf_dir)
        left[fn.__name__] = made
        return out

    return run


@_step
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with letters, most of them in one learned language."""
    return langid.keep_identified(docs, langid.train(docs), least=LEAST_SHARE)


@_step
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the largest id of equal texts."""
    return dedup.drop_copies(docs)


@_step
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of similar shingle sets; of rows that share that id, one. A null id is above all others."""
    rows, key, added = keyed(docs, "doc_id")
    classes = jaccard.near_duplicates(rows, key)
    if not added:
        return without(docs, key, stage(classes.where("doc_id <> component_id").select("doc_id")))
    # ids repeat or are missing: classes of rows, of which the one with the least id stays
    own = rows.select(F.col(key).alias("row"), F.col("doc_id").alias("own"))
    stay = classes.join(own, F.col("doc_id") == F.col("row")).groupBy("component_id").agg(F.min_by("row", F.struct(F.col("own").isNull(), "own", "row")).alias("stay"))
    stay = stay.select(F.col("stay").alias(fresh(rows, "stay")))
    return rows.join(stay, F.col(key) == stay[stay.columns[0]], "left_semi").drop(key)


@_step
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in texts."""
    return secret_scan.mask_secrets(docs)


@_step
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs).drop("ids")


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("secrets", secrets), ("packed", packed)]

#: The first, fourth and fifth stages have no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the table ``documents``. A run accounts for its own folders: what its result reads stays, also when the pipeline runs again."""
    docs, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for _, step in STAGES[:-1]:
        kept = stage(step(spark, docs, sf_dir, left))
        release(docs)  # only a table that a stage before this one was written to
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir, left)
