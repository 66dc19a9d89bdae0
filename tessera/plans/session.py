"""Session helpers: where lineage is cut, and how wide small reads are."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only on a local master that names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    where = named or tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that later reads survive lost executors.

    A written table also starts anew with its real size. A checkpoint would keep the estimate of its plan, and
    estimates of joins multiply: over the rounds of a loop they grow to numbers that take the driver minutes.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
