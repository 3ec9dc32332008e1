"""Small files on any Hadoop file system, next to the Parquet data."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def working_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share.  Where that is unset, a cluster takes a folder of the
    warehouse, which is shared too, and a local session (tests) a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("veldra.work.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            found = "file://" + tempfile.mkdtemp(prefix="veldra-work-")
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/veldra-work"
        spark.conf.set("veldra.work.dir", found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed over the old file in one step, so readers see the old or the new text."""
    fs, target = _at(spark, path)
    _, fresh = _at(spark, path + ".new")
    stream = fs.create(fresh, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.valueOf("OVERWRITE")
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, how)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)
