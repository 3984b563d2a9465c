"""Tables written to the shared folder, which end a lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[str] = []


def _folder(spark, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def forget(spark) -> None:
    """Delete the tables that staged() has written so far; frames read from them can no longer be used."""
    while _STAGED:
        files, path = _folder(spark, _STAGED.pop())
        files.delete(path, True)


def finished(spark, path: str) -> bool:
    """Whether a whole table stands at path: a writer leaves its mark last."""
    files, mark = _folder(spark, f"{path}/_SUCCESS")
    return files.exists(mark)


def kept(df: DataFrame, path: str) -> DataFrame:
    """df written to a path of its own, which later sessions find again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
