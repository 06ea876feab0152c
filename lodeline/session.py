"""Session helpers: reading tables, shared checkpoint folder, bounded dimensions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Row, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset and the
    session is a single process (tests, notebooks), a temporary folder is set,
    once per session; on a cluster a missing setting is an error, as a folder of
    one machine isn't shared.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodeline-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """The rows of a dimension that is documented to be small.

    More than ``limit`` rows raise ``ValueError``: a table that grows must be
    joined, not collected.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} holds more than {limit} rows; it can't be used as a fixed dimension")
    return rows
