"""Topics of events as a log with offsets, read by subscribers that each keep their own place (STR-1).

The log grows by whole batches, each a folder that counts once its writer has committed, so a batch that is published
again changes nothing. A subscriber that falls behind by more than `bound` events of a topic loses its oldest: it
reads the latest `bound` and is told how many it lost. Places are written after events are dealt with, so a
subscriber that dies in between reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Events of a topic that wait for a subscriber.
BOUND = 256
_LOG = "topic string, offset long, payload string"
_PLACES = "topic string, offset long"


def _committed(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of a folder's batches whose writers have committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith("n=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


class Topics:
    """A log in a folder that the driver and all executors share. One writer at a time; readers as many as you like."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, folder: str, schema: str, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{folder}/n={n}" for n in numbers])

    def log(self) -> DataFrame:
        """topic, offset and payload of all that was published."""
        return self._read(f"{self.path}/log", _LOG, _committed(self.spark, f"{self.path}/log"))

    def heads(self) -> DataFrame:
        """topic and head: the offset that its next event gets."""
        return self.log().groupBy("topic").agg((F.max("offset") + 1).alias("head"))

    def publish(self, events: DataFrame, batch_id: int) -> bool:
        """Appends events (topic, seq, payload), a topic's in order of seq; False if this batch was published before."""
        if batch_id in _committed(self.spark, f"{self.path}/log"):
            return False
        nth = F.row_number().over(Window.partitionBy("topic").orderBy("seq")) - 1
        rows = events.where("topic IS NOT NULL").select("topic", nth.alias("nth"), "payload").join(self.heads(), "topic", "left")
        rows = rows.select("topic", (F.coalesce("head", F.lit(0)) + F.col("nth")).cast("long").alias("offset"), "payload")
        rows.write.mode("overwrite").parquet(f"{self.path}/log/n={batch_id}")
        return True

    def writer(self) -> Callable[[DataFrame, int], None]:
        """What foreachBatch of a stream of events takes; a batch that is run again after a failure is published once."""
        return lambda df, batch_id: self.publish(df, batch_id) and None

    def places(self, subscriber: str) -> DataFrame:
        """topic and offset: the first that the subscriber has not dealt with; topics it never read are missing."""
        folder = f"{self.path}/places/{subscriber}"
        return self._read(folder, _PLACES, _committed(self.spark, folder)[-1:])

    def poll(self, subscriber: str, bound: int = BOUND) -> DataFrame:
        """topic, offset, payload and lost (how many older ones of the topic this subscriber never saw) of what waits for it."""
        at = self.heads().join(self.places(subscriber).withColumnRenamed("offset", "place"), "topic", "left")
        at = at.withColumn("place", F.coalesce("place", F.lit(0)).cast("long")).withColumn("start", F.greatest("place", F.col("head") - bound))
        waiting = at.select("topic", "start", (F.col("start") - F.col("place")).alias("lost"))
        return self.log().join(waiting, "topic").where("offset >= start").select("topic", "offset", "payload", "lost")

    def commit(self, subscriber: str, polled: DataFrame) -> None:
        """The subscriber has dealt with what it polled; its other topics keep their places."""
        folder = f"{self.path}/places/{subscriber}"
        new = polled.groupBy("topic").agg((F.max("offset") + 1).cast("long").alias("offset"))
        rows = self.places(subscriber).unionByName(new).groupBy("topic").agg(F.max("offset").alias("offset"))
        n = max(_committed(self.spark, folder), default=-1) + 1
        rows.write.mode("overwrite").parquet(f"{folder}/n={n}")
