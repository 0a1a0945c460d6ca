"""Where tables are written between the steps of a query."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is sent to every executor; beyond it a join shuffles both sides.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where none is set, a temporary one, in local mode only."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    folder = sc.getConf().get("spark.checkpoint.dir") or (there.get() if there.isDefined() else None)
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not there.isDefined():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` written once, and marked to be broadcast in joins if it has at most `most` rows."""
    done = checkpointed(df)
    return F.broadcast(done) if done.count() <= most else done
