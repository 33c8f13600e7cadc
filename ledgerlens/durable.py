"""Tables written once and read again, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and the master is local, as in tests, a folder of the session's own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = _OWN.get(context.applicationId) or _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="ledgerlens-"))
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    except Exception:  # noqa: BLE001  the session has ended before the driver; the folder goes with the cluster's
        pass


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def once(df: DataFrame, name: str) -> DataFrame:
    """df as it stands now: written, and read again by whatever needs it. Its lineage ends here; it goes when the driver ends."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
