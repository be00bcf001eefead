"""Cutting lineage on storage that every executor can read."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The session's ``spark.checkpoint.dir`` (or a directory set on the context) always wins. Only a
    local-mode session without either gets a folder of this machine, since there the driver is the
    sole executor.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master or "").startswith("local") or (sc.master or "").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="siftspark-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; a lost executor loses nothing of it."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    On a cluster the package is installed, shared, or submitted with --py-files; this only adds its
    folder to the workers' search path, so that a driver started elsewhere finds it too.
    """
    import importlib.util

    root = str(Path(importlib.util.find_spec("siftspark").origin).parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
