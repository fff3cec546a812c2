"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as literal characters.
BLANKS = " \t\n\x0b\x0c\r"
#: Copies of a small table, and parts of each key of the large one, in ``lookup``.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is set only where it is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared checkpoint folder, forget the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """As ``cut``, but as Parquet: the planner knows the true size before it chooses a join.

    The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, small: DataFrame, keys: list[str], salt=None, how: str = "left") -> DataFrame:
    """Join ``rows`` to a per-key table on null-safe equal keys, each key unique in ``small``.

    ``small`` is settled, so Spark broadcasts it only if its written size is under
    ``spark.sql.autoBroadcastJoinThreshold``.  Beyond that both sides are shuffled by key and
    salt: ``salt`` is a column that spreads the rows of a hot key over ``SALTS`` parts.  Without
    it (tables that are large themselves, with few hot keys) Spark splits the partitions of hot
    keys of a sort-merge join, as the result needs no order or clustering."""
    small = settled(small)
    limit = int(small.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size = int(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    named = {k: f"__key_{k}" for k in keys}
    small = small.withColumnsRenamed(named)
    on = F.lit(True)
    for k, n in named.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    if limit >= size:
        small = F.broadcast(small)
    elif salt is not None:
        small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__part", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
        on = on & (F.col("__part") == F.col("__salt"))
    return rows.join(small, on, how).drop(*named.values(), "__salt", "__part")
