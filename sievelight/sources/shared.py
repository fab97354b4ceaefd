"""Where checkpoints go: the session's own setting, or a local folder where there is none."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the context's folder as they are; only a local session that
    has neither (a test) gets a folder of its own, as executors can't share one elsewhere."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not found and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="sievelight-"))
    return (found or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def held(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for what is read several times."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
