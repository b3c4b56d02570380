"""Helpers shared by the training-data operators: tables, lineage cuts, connected components."""

from __future__ import annotations

import atexit
import gc
import itertools
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A parquet table of the test data, with the named columns only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(column):
    """Lower-cases A to Z and nothing else."""
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset on one machine (master local) a temporary one.

    On a cluster without it this raises RuntimeError: a temporary folder would be another one on each machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="steadfast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables that cut() writes from one release() to the next: plans of that many jobs are held by the driver at most.
CUTS = 8
_cuts = itertools.count(1)


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: later work doesn't repeat it, and lost executors lose nothing.

    The table is deleted when the driver ends. Each CUTS tables the driver's memory is released.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steadfast-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    written = spark.read.schema(df.schema).parquet(path)
    written._path_of_cut = path
    if next(_cuts) % CUTS == 0:
        release(spark)
    return written


#: Rows of a batch that goes to Python: texts are large, and both sides hold whole batches.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches lowered to BATCH_ROWS rows, where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and no later step reads, and lets Spark drop the shuffle files of finished steps.

    Spark deletes a shuffle's files once the driver has collected what refers to them, which it may not do for long.
    """
    for t in tables:
        _remove(spark, t._path_of_cut)
    release(spark)


def release(spark: SparkSession) -> None:
    """Gives memory of the driver that finished steps leave back to the machine: the heap's, and what the C library keeps.

    An operator of a hundred jobs leaves plans, and threads' and compilers' freed blocks, which the driver otherwise
    holds on to until its heap is full, whatever the size of the tables.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> bool:
    """malloc_trim in the driver's JVM, where that has such a command (HotSpot on Linux); whether it ran."""
    gateway, java = spark.sparkContext._gateway, spark.sparkContext._jvm.java
    try:
        # called by reflection, as the bean's own class is in a closed module
        of, given = gateway.new_array(java.lang.Class, 4), gateway.new_array(java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            of[i] = java.lang.Class.forName(name)
        given[0], given[1] = spark.sparkContext._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call = java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", of)
        call.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # another JVM or an older one
        return False
    return True


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the cluster's own cleaning of the folder applies
        pass


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node, the component being its smallest node.

    Each round takes the smallest label among a node's neighbours, then follows labels of labels, so that long
    chains halve. All of it is aggregation with map-side combine and equi-joins that Spark can split where a node is hot.
    Raises RuntimeError if labels still change after `rounds` rounds (chains of 2**rounds nodes).
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("before"))
        via = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        # labels only ever go down along existing links, so the label of the label is in the same component
        step = cut(step.join(via, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), "before"))
        changed = step.filter("component <> before").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components still change after {rounds} rounds")
