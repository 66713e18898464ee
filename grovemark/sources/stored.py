"""Cutting the lineage of tables that rounds of a job build on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read from there: a lost executor costs a re-read.

    Where the session names none, one is made on a single machine (tests); on a cluster that is an error, since executors
    would not see it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="grovemark-"))
    return df.checkpoint(eager=True)
