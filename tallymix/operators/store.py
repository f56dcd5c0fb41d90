"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the session's ``spark.checkpoint.dir``; where that is unset, a temporary folder on one machine, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallymix-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tallymix-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a table and reads it: cuts lineage without the driver, and survives lost executors."""
    path = path or shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to Python, unless the session sets fewer.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets Spark cut Arrow batches by bytes, where rows are packed."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None) or ""
    if not own.rstrip("b").isdigit() or int(own.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table that ``stored`` has written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
