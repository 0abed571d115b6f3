"""The folder that all executors share.

Lineage is cut, and tables that several jobs read are kept, in the folder that
the cluster names in ``spark.checkpoint.dir``.  Where the setting is missing,
as in local tests, a temporary folder is set.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from rankspark.sources import files

_NAME = re.compile(r"-[0-9a-f]{32}$")


def shared_dir(spark: SparkSession) -> str:
    set_now = spark.sparkContext.getCheckpointDir()
    if set_now:
        return set_now
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="rankspark-")
        atexit.register(shutil.rmtree, local, True)
        named = "file://" + local
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder, one folder a value of ``by``; the table read back and its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def clean_stored(spark: SparkSession, hours: float) -> int:
    """Delete stored tables that are ``hours`` old or older, as no result reads them any more; how many there were."""
    root, count = shared_dir(spark), 0
    for name in files.names(root, folders=True):
        if _NAME.search(name) and files.age(f"{root}/{name}") >= hours * 3600:
            files.delete(f"{root}/{name}")
            count += 1
    return count
