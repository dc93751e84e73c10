"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillstack-")
    return _own_dirs[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/quillstack-{uuid.uuid4().hex}/{label}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if f"{scratch_root(spark).split(':')[-1].lstrip('/')}/quillstack-" in folder:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
