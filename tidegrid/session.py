"""Session construction for local runs, and the checkpoint folder rule."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session for tests and benchmarks on one machine. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: the session's ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder, because executors on other machines could not
    read it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
            folder = tempfile.mkdtemp(prefix="tidegrid-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there, so its lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
