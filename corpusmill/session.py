"""Session defaults, table reading and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings an operator relies on; a cluster's own values for anything else are left alone.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "corpusmill") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=REQUIRED)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("CORPUSMILL_DRIVER_MEMORY", "8g"))
    spark = builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the session runs on this machine alone
    a temporary folder is chosen; on a cluster a missing setting is an error, since executors would write to their own
    disks.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusmill-checkpoint-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, so that lost executors never force a recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Input below so many bytes a core is worth spreading when it lies in few files.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame, derived: bool = False) -> DataFrame:
    """``df`` over all cores where its files are too few to occupy them and small; otherwise as it is.

    With ``derived`` a small input without files, such as one whose lineage was cut, is spread too.

    A file's row group is read by one task, so a small table in one file would keep one core busy with work that
    should be shared. Result rows are the same either way. A large input is told by the plan's statistics, which the
    scan has already; only a small one's files are listed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * SPREAD_BYTES or size >= 2 * cores * int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()):
        return df
    files = len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores or derived and not files else df
