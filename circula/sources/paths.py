"""Folder helpers that work on any Hadoop-compatible store (HDFS, S3, local)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from circula.session import ensure_checkpoint_dir


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder inside the shared checkpoint folder (never machine-local
    on a cluster: ``spark.checkpoint.dir`` names shared storage)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename_path(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder in one step; ``to`` must not be there."""
    fs, p = _fs(spark, path)
    if not fs.rename(p, _fs(spark, to)[1]):
        raise OSError(f"could not rename {path} to {to}")
