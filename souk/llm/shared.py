"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process (tests) a local one."""
    path = spark.conf.get(SETTING, None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} names no folder that the cluster's executors share")
        path = "file://" + tempfile.mkdtemp(prefix="souk-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a reliable cut that column-prunes."""
    path = table_path(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def table_path(df: DataFrame, name: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``table`` wrote, once all that reads them has been written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` whose workers find this package where the driver found it (a cluster ships it with --py-files)."""
    paths = df.sparkSession.sparkContext.environment
    if ROOT not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [paths.get("PYTHONPATH"), ROOT]))
    return df.mapInArrow(run, schema)
