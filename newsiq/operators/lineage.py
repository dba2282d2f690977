"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one ``spark.checkpoint.dir`` names, else one inside the warehouse.

    Both are shared by all machines of a cluster; a machine-local folder would
    not survive the machine.  Clean it by age, nothing here deletes from it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"
        if not spark.sparkContext.master.startswith("local") and folder.split(":")[0] in ("file", folder):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder.rstrip("/")


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from there.

    A written table keeps column pruning and real size statistics for the
    joins that follow, which a checkpointed RDD would not.
    """
    path = f"{shared_folder(df.sparkSession)}/newsiq-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
