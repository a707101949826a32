"""Small helpers around the Spark session: shared folders, written intermediates, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows, at their fixed width, stay below this many bytes.
BROADCAST_BYTES = 32 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir.

    Where a local session names none (tests), one folder is made for this process and set as the
    checkpoint folder; a session on a cluster has to name one.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: the lineage is cut and
    the rows survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def united(a: DataFrame, b: DataFrame, allowMissingColumns: bool = False) -> DataFrame:
    """``a`` and ``b`` by column name. All unions of the library are made here.

    Spark 4.1 takes a union of frames that are partitioned by one key for partitioned by it. Where such a
    union is grouped by the key and joined with frames of the same source, the grouping then gives several
    rows a key. The setting that does so is turned off in the session.
    """
    a.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return a.unionByName(b, allowMissingColumns=allowMissingColumns)


def bounded_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """Have Spark hand rows to Python in batches of ``rows`` at most, so that a worker never holds a
    whole partition of texts; a session that asks for less keeps its setting."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def small_enough(rows: int, row_bytes: int) -> bool:
    """Whether so many rows of a fixed width may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side that is joined by shuffle. Spark takes what ``explode`` makes for no larger than its
    input, and a Parquet file for as large as it lies on disk, so it would broadcast whole pixel tables;
    no such side goes through the driver."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all shuffle partitions. A few bytes here stand for thousands of pixels, so Spark
    would take the partitions together and leave most cores idle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def per_document(rows: DataFrame, row_bytes: int = 72) -> DataFrame:
    """The written table ``rows`` of one short row a document, as the side that pixels are joined with: broadcast
    only while its counted rows allow it, so that Spark never takes the pixels for the smaller side."""
    return F.broadcast(rows) if small_enough(rows.count(), row_bytes) else by_shuffle(rows)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one-column frame ``ids`` of ``n_ids`` distinct values.

    The ids are broadcast only while their counted size allows it; beyond that Spark joins by
    shuffling both sides.
    """
    side = F.broadcast(ids) if small_enough(n_ids, 16) else ids
    return df.join(side, key, "left_semi")
