"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "lendbook", driver_memory: str | None = None) -> SparkSession:
    """A session with the settings the jobs are written for.

    On a cluster leave ``master`` out and let spark-submit decide.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # No call-site record per expression: it costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, which has no other
    machine to share with, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = _LOCAL_FOLDERS.get(context.applicationId)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="lendbook-")
            _LOCAL_FOLDERS[context.applicationId] = folder
    if context.applicationId not in _CHECKPOINTED:
        context.setCheckpointDir(folder)
        _CHECKPOINTED.add(context.applicationId)
    return f"{folder.rstrip('/')}/{context.applicationId}"


def remove_work(spark: SparkSession) -> None:
    """Delete the application's work folder and everything in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_LOCAL_FOLDERS: dict[str, str] = {}
_CHECKPOINTED: set[str] = set()
