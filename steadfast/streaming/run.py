"""Running a stream over what is there now, and reading what it gave."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir; a temporary one where it is unset on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="steadfast-")
    return f"{shared}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, name: str, per_trigger: int = 100) -> DataFrame:
    """The Parquet table `name` of a folder as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    # as a pattern that only the table's own name fits, since a stream's plain path must be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path[:-1]}[t]")


def available_now(stream: DataFrame, timeout: int = 3600) -> DataFrame:
    """Runs a stream until its input is used up, into a table in the shared folder, and reads that."""
    folder = work_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream took more than {timeout} seconds")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
