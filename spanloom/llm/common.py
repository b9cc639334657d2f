"""Helpers shared by the operators of this package."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_WS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, ``spark.checkpoint.dir``. Where that is unset, as in tests, a folder of the warehouse is used."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back; for tables that a loop makes anew from themselves.

    A checkpoint keeps the estimated size of its plan, and that of a join is the product of its sides. Over the rounds of a loop the
    number of digits doubles each time, until estimates alone fill the driver. A table has the size of its files.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch with texts.
BATCH_ROWS = 256
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands rows to Python in batches of at most ``BATCH_ROWS``; a setting of the user holds.

    Ten thousand rows, the default, are tens of MB of text: each task holds such buffers outside the heap, on both sides of each
    Python step, and the executor does not give back all of that memory.
    """
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold_id(col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(col.cast("string").cast("binary")) % folds


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5; nulls count as empty text."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A key that holds a thousandth of all rows is hot, so there are at most a thousand hot keys.
HOT_SHARE = 1000


def hot_keys(sizes: DataFrame, n: str = "n", least: int = 1000) -> DataFrame:
    """The rows of ``sizes`` (one per key, with ``n`` rows each) whose key holds a thousandth of all rows or more, and ``least`` rows: at most a thousand."""
    total = sizes.agg(F.sum(n)).collect()[0][0] or 0
    return sizes.filter(F.col(n) >= max(least, -(-total // HOT_SHARE)))


def split_join(left: DataFrame, right: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join with a table of one narrow row per key, which says in ``n`` how many rows of the left side it meets.

    The hot keys, a thousand at most, are broadcast; the others meet in a shuffle.
    """
    hot = checkpointed(hot_keys(right, n))
    if hot.isEmpty():
        return left.join(right.drop(n), on)
    marks = hot.select(*on, F.lit(True).alias("_hot"))
    met = left.join(F.broadcast(hot.drop(n)), on)
    cold = left.join(F.broadcast(marks), on, "left_anti").join(right.join(F.broadcast(marks), on, "left_anti").drop(n), on)
    return met.unionByName(cold)
