"""Session-level helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (a single file or a directory of parts)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where it is unset (local tests) a folder of our own is used, and only with a local
    master."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tracequarry-ckpt-", dir=os.environ.get("TMPDIR"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder (see :func:`shared_folder`) and return it without lineage.

    A lost executor loses nothing. The files are deleted by Spark once no DataFrame refers
    to them any more, unless the session says that checkpoints are to be kept."""
    spark = df.sparkSession
    shared_folder(spark)
    setting = "spark.cleaner.referenceTracking.cleanCheckpoints"
    if spark.sparkContext.getConf().get(setting) is None:
        spark.sparkContext._jsc.sc().conf().set(setting, "true")
    return df.checkpoint(eager=True)


@contextmanager
def many_columns() -> Iterator[None]:
    """While thousands of column expressions are built: without noting for each the line it came from.

    That is an aid of PySpark's for error messages (``spark.python.sql.dataFrameDebugging.enabled``)
    and takes longer than the calls themselves; where it works otherwise nothing is changed."""
    import pyspark.errors.utils as origin

    if not hasattr(origin, "_enable_debugging_cache"):
        yield
        return
    before = origin._enable_debugging_cache
    origin._enable_debugging_cache = False
    try:
        yield
    finally:
        origin._enable_debugging_cache = before
