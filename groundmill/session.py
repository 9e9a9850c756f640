"""Session helpers: table reading and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Inputs of more bytes a core than this are left as they are read.
SMALL_A_CORE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input in fewer files than there are cores, dealt over all cores; any other as it is.

    For work that is heavy a row. A large input has splits enough, and moving it would cost more than it gains.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > cores * SMALL_A_CORE or not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a private one in local mode, as in tests; on a cluster an error, as other hosts cannot read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="groundmill-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/groundmill-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts the lineage and survives lost executors.

    The table stays for as long as a result may still be read from it; see :func:`discard_written`.
    """
    path = f"{_own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key that at least one in so many rows has is joined by broadcast.
HOT_SHARE = 10_000


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per key and in ``weight`` how many rows of ``left`` have it.

    Keys of at least one row in ``HOT_SHARE`` are at most so many, and are broadcast; the others are shuffled. ``total``
    is the number of rows of ``left``.
    """
    is_hot = F.col(weight) * HOT_SHARE >= total
    names = [c for c in right.columns if c not in (key, weight)]
    met = left.join(F.broadcast(right.where(is_hot).select(key, F.struct(*names).alias("__hot"))), key, "left")
    hot = met.where("__hot is not null").select(*left.columns, *(F.col("__hot")[c].alias(c) for c in names))
    rest = met.where("__hot is null").select(*left.columns).join(right.where(~is_hot).select(key, *names), key, "left")
    return hot.unionByName(rest.select(hot.columns))


_TURNS = count(1)
_turn = 0


def generation() -> int:
    """Changes whenever the written tables are discarded, for those who keep one over several calls."""
    return _turn


def discard_written(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder, once its results are stored elsewhere."""
    global _turn
    _turn = next(_TURNS)
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
