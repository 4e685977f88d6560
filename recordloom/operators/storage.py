"""Tables in the folder that driver and executors share, used to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_noted: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application.

    It is the session's ``spark.checkpoint.dir``. Only where none is set and the master is local,
    as in tests, a temporary folder becomes the checkpoint folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='recordloom-')}")
            held = spark.sparkContext.getCheckpointDir()
        base = held
    own = f"{base.rstrip('/')}/recordloom-{spark.sparkContext.applicationId}"
    if own not in _noted:
        _noted.add(own)
        atexit.register(release, spark)
    return own


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder; results that still read them are void.

    Call it when the results are written. It happens by itself when the driver's Python ends with the session alive.
    """
    context = spark.sparkContext
    if context._jsc is None:  # stopped
        return
    for own in _noted:
        if own.endswith(f"recordloom-{context.applicationId}"):
            path = context._jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs only its running tasks. Unlike a checkpointed frame, the
    result carries no partitioning, so a later join shuffles both sides and Spark can split
    a hot key.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
