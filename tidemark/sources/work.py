"""Folders for what a job writes on its way."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which the whole cluster shares; where that is unset, one of our own in local mode and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = _own_folder()
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """frame written to a fresh folder and read back, so that what is dear to make is made once and survives lost executors."""
    path = work_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
