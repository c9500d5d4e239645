"""Intermediate tables that survive the loss of executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def own_folder() -> str:
    """A folder for sessions on one machine, removed when the process ends."""
    path = tempfile.mkdtemp(prefix="spanloom-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session whose tasks all run in the driver's own process sets one of its own; a cluster
    without the setting gives an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[\d*,]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = own_folder()
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a compressed columnar table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
