"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder checkpoints go to.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only a local session without one
    gets a temporary folder, removed at its end; any other session must name one, as a machine-local folder is not
    readable by other executors.
    """
    context = spark.sparkContext
    if folder := context.getCheckpointDir():
        return folder
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="papyrion-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def settle(df: DataFrame) -> DataFrame:
    """`df`, computed once and written to the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def if_small(df: DataFrame, most: int = 16_000_000) -> DataFrame:
    """`df` (settled before, as it is read once more), to be broadcast if its values take at most `most` bytes; else as it is."""
    sizes = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(0) for f in df.schema.fields]
    row = sum(sizes, F.lit(16 + 8 * len(sizes)))
    held = df.select(F.sum(row.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if held <= most else df
