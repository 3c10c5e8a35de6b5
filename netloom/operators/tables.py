"""What large jobs share: results that last, joins that split hot keys, and prefix sums without a window over a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most keys that are called hot and sent to all tasks, and rows of a key below which it is never hot.
HOT_KEYS, HOT_ROWS = 10_000, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder for what must last: ``spark.checkpoint.dir``, or in a local session without one a folder beside the warehouse."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return sc.getCheckpointDir()


def lasting(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as a table in the shared checkpoint folder, so that a lost executor costs no rerun of what came before.

    A table is written by one run where ``checkpoint()`` takes two, and it is
    read with its true size: sizes guessed through rounds of joins grow without
    end. In a session on a cluster ``spark.checkpoint.dir`` must be set.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.kept_at = path
    if scratch._open:
        scratch._open[-1].made.append(table)
    return table


def forget(*tables: DataFrame) -> None:
    """Removes the files of tables made by ``lasting`` that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class scratch:
    """A block after which the tables that ``lasting`` made in it are removed, but for those given to ``keep``.

    Blocks may be nested: what an inner one keeps is the outer one's to remove.
    """

    _open: list[scratch] = []

    def __init__(self) -> None:
        self.made: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __enter__(self) -> scratch:
        self._open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        self._open.remove(self)
        stay = {df.kept_at for df in self.kept}
        forget(*[df for df in self.made if df.kept_at not in stay])
        if self._open:
            self._open[-1].made += [df for df in self.made if df.kept_at in stay]


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores before it until it is no column of ``df``."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish = f"_{wish}"
    return wish


def meet(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``per_key``, which has each of ``keys`` once and tells in ``count`` how many of the ``total`` rows have it.

    Keys with more than a ten-thousandth of the rows are hot: at most HOT_KEYS
    of them, so they are sent to all tasks and their rows stay where they are.
    The other keys are dealt, and none brings a task more than that share.
    ``rows`` is read twice: it should be cheap, or lasting. Null keys meet nothing.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    mark = free_name(rows, "__hot")
    hot = F.broadcast(per_key.where(F.col(count) > limit))
    rest = rows.join(F.broadcast(hot.select(*keys).withColumn(mark, F.lit(True))), keys, "left").where(F.col(mark).isNull()).drop(mark)
    return rows.join(hot, keys).unionByName(rest.join(per_key.where(F.col(count) <= limit), keys))


def running(sums: DataFrame, by: list[str], bucket: str, amount: str, block: int = 1024) -> DataFrame:
    """(*by, bucket, before): the sum of ``amount`` over the buckets below, within ``by``; buckets are numbers from 0, one row each.

    Buckets are summed in blocks first, so no window holds more than ``block`` of them, or more than one row a block.
    """
    sums = sums.select(*by, bucket, F.col(amount).cast("long").alias("__a"), F.floor(F.col(bucket) / block).alias("__k"))
    below = lambda keys, order, x: F.coalesce(F.sum(x).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = sums.groupBy(*by, "__k").agg(F.sum("__a").alias("__whole"))
    whole = whole.select(*by, "__k", below(by or [F.lit(0)], "__k", "__whole").alias("__base"))
    inside = sums.withColumn("__inside", below([*by, "__k"], bucket, "__a"))
    return inside.join(whole, [*by, "__k"]).select(*by, bucket, (F.col("__base") + F.col("__inside")).alias("before"))
