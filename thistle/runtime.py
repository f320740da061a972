"""Session helpers: shared storage, lineage cuts and table loading."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode, and RuntimeError on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="thistle-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass


def _drop_all() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            _drop(spark, path)


atexit.register(_drop_all)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/thistle-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, *keys: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and lost executors don't matter.

    keys: sorts each file by these columns, so that later filters skip row groups.
    """
    spark = df.sparkSession
    path = scratch(spark)
    (df.sortWithinPartitions(*keys) if keys else df).write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._thistle_path = path
    return back


def cut_counted(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
    """As cut(), with aggregates of the rows taken while they are written, without a job of their own."""
    seen = Observation()
    back = cut(df.observe(seen, *(c.alias(k) for k, c in aggregates.items())))
    return back, seen.get


def forget(df: DataFrame | None) -> None:
    """Deletes a table made by cut() that nothing reads any more."""
    path = getattr(df, "_thistle_path", None)
    if path:
        _drop(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the executors' Python, wherever the driver has it from; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_thistle_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="thistle-"), "thistle.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(archive)
    sc._thistle_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow with functions of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
