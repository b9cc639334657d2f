"""Size checks that guard every broadcast and every driver-side read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint when the row count is proven small; otherwise leave the join to Spark."""
    return F.broadcast(df) if fits(df, max_rows) else df


def cut_lineage(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write a stage to the checkpoint folder of the session and read it back.

    The folder is the shared one the cluster names in ``spark.checkpoint.dir``. Only where
    that is unset, as in tests, a folder of the warehouse is used.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(folder or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)
