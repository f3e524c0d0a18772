"""Cutting lineage with tables written to the folder that all executors share.

Every table that an application spools lies in one folder of its own, `<spark.checkpoint.dir>/quillspan-<application id>`;
that folder is the owner of its tables. `discard` deletes a table as soon as it has been read for the last time, and
`drop_spools` deletes the folder.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session that runs in one process may go without: it gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quillspan-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, kind: str = "spool") -> str:
    return f"{own_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def spool(df: DataFrame, *partition_by: str, path: str | None = None) -> DataFrame:
    """Write `df` as parquet into the shared folder and return a scan of it.

    The result no longer depends on executors' shuffle files, so it survives their loss, and several readers of it
    don't compute it again.
    """
    path = path or new_path(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def observed(seen: Observation, name: str) -> int:
    """A metric of an observation; 0 where the plan was found to be empty before it ran, which leaves no metrics."""
    try:
        return seen.get.get(name) or 0
    except Py4JJavaError:
        return 0


def counted(df: DataFrame, condition: Column | None = None, path: str | None = None) -> tuple[DataFrame, int]:
    """`spool`, and the number of rows (that meet the condition), counted while they are written."""
    seen = Observation()
    n = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    out = spool(df.observe(seen, n.alias("n")), path=path)
    return out, observed(seen, "n")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_spooled", None):
            delete(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to: it learns of them by a collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_spools(spark: SparkSession) -> None:
    """Delete everything that this application has spooled."""
    delete(spark, own_folder(spark))
