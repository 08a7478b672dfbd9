"""Where intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and its lineage cut, by a reliable checkpoint. The session's own folder is used; only where none is set
    (tests) a temporary one becomes it, and only if all of Spark runs on this machine: a cluster without a shared folder is an error."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="trackloom-"))
    return df.checkpoint()
