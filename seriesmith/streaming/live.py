"""Structured Streaming versions of the bar builder and the progress view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import arrival

TICK_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
PROGRESS_SCHEMA = (
    "run string, symbol string, updated bigint, trials_completed bigint, trials_total bigint, best_value double, is_result boolean"
)


def hourly_bars(ticks: DataFrame, late: str = "2 hours") -> DataFrame:
    """Ticks ``(symbol, ts, seq, price)`` to hourly bars.

    Repeated ticks are dropped while the watermark still covers them; a bar is emitted
    when the watermark passes its end.  First and last price are picked by event time, so
    the order of arrival does not matter.  Works on a stream and on a batch.
    """
    at = arrival("ts", "seq")
    marked = ticks.withWatermark("ts", late)
    once = (
        marked.dropDuplicatesWithinWatermark(["symbol", "seq"]) if ticks.isStreaming
        else marked.dropDuplicates(["symbol", "seq"])
    )
    return (
        once.groupBy("symbol", F.window("ts", "1 hour").alias("w"))
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", at).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.unix_seconds("w.start").alias("t"), "open", "high", "low", "close", "volume")
    )


def tick_stream(spark: SparkSession, folder: str, per_trigger: int = 1000, name: str = "*.parquet") -> DataFrame:
    raw = spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", per_trigger).option(
        "pathGlobFilter", name).parquet(folder)
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), (F.lit(100.0) + F.col("value") / 10).alias("price"))


def open_ticks(ticks: DataFrame, closed: DataFrame) -> DataFrame:
    """Ticks behind the last closed bar: the watermark closes bars of all symbols alike."""
    last = closed.agg(F.coalesce(F.max("t"), F.lit(-1).cast("bigint"))).scalar()
    return ticks.filter(F.unix_seconds(F.col("ts").cast("timestamp")) >= F.when(last >= 0, last + 3600).otherwise(last))


def latest_progress(updates: DataFrame) -> DataFrame:
    """Newest state per (run, symbol); the same code runs on stream and batch.

    A pair is done when its result has been written (``is_result``), whatever number of trials it
    took; the result row then gives the figures, else the newest progress row."""
    order = F.struct(F.coalesce("is_result", F.lit(False)), "updated", "trials_completed")
    last = F.max_by(F.struct("trials_completed", "trials_total", "best_value", "updated"), order)
    done = F.max(F.coalesce("is_result", F.lit(False)))
    g = updates.groupBy("run", "symbol").agg(last.alias("l"), done.alias("done"))
    return g.select(
        "run", "symbol", F.col("l.updated").alias("updated"), F.col("l.trials_completed").alias("completed"),
        F.col("l.trials_total").alias("total"), F.col("l.best_value").alias("best_value"),
        F.when(F.col("done"), "done").otherwise("running").alias("status"))


def progress_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(PROGRESS_SCHEMA).option("maxFilesPerTrigger", per_trigger).json(folder)


UPDATE = ["run", "symbol", "updated", "trials_completed", "trials_total", "best_value", "is_result"]
#: Batches after which the table of progress is folded into one snapshot.
FOLD_EVERY = 16


def newest(updates: DataFrame) -> DataFrame:
    """The update that counts for each (run, symbol), as an update row."""
    order = F.struct(F.coalesce("is_result", F.lit(False)), "updated", "trials_completed")
    g = updates.groupBy("run", "symbol").agg(F.max_by(F.struct(*UPDATE[2:]), order).alias("u"))
    return g.select("run", "symbol", "u.*")


class ProgressTable:
    """Progress keyed by (run, symbol), upserted by a stream.

    A batch leaves one row a key in the folder of its number, which a replay of the batch overwrites
    with the same rows: the upsert is idempotent by (batch, key).  Reading merges the last snapshot with
    the batches behind it; the newest update of a key wins whatever the order of arrival.  Every
    ``FOLD_EVERY`` batches are folded into a new snapshot, so a reader meets at most that many
    batches and one row a key, however long the stream has run."""

    def __init__(self, spark: SparkSession, root: str, every: int = FOLD_EVERY):
        self.spark, self.root, self.every = spark, root, every

    def _rows(self, kind: str) -> DataFrame:
        """All rows of a kind of folder with its number ``n``; none before the first one is written."""
        empty = self.spark.createDataFrame([], f"{PROGRESS_SCHEMA}, n bigint")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        if not place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
            return empty
        return self.spark.read.schema(f"{PROGRESS_SCHEMA}, n bigint").parquet(f"{self.root}/{kind}")

    def upsert(self, updates: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        newest(updates.select(*UPDATE)).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batches/n={batch}")
        if batch % self.every == self.every - 1:
            self.updates(upto=batch).write.mode("overwrite").parquet(f"{self.root}/snapshots/n={batch}")

    def updates(self, upto: int | None = None) -> DataFrame:
        """The newest update of each key, as of batch ``upto``."""
        end = F.lit(2 ** 62 if upto is None else upto)
        # the snapshot of the batch itself may be half written when the batch is replayed
        snapshots = self._rows("snapshots").filter(F.col("n") < end)
        last = snapshots.agg(F.coalesce(F.max("n"), F.lit(-1).cast("bigint"))).first()[0]
        rows = snapshots.filter(F.col("n") == last).unionByName(
            self._rows("batches").filter((F.col("n") > last) & (F.col("n") <= end)))
        return newest(rows)

    def view(self) -> DataFrame:
        return latest_progress(self.updates())

    def run(self, updates: DataFrame, checkpoint: str):
        """Start the stream ``updates`` into this table and end when its input is read."""
        return updates.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).outputMode(
            "update").trigger(availableNow=True).start()
