"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quernel", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are written for.

    On a cluster the caller brings a session of its own; nothing below relies on local mode.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder, set if it is not yet."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix=f"quernel-{os.getpid()}-")
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path for files that all executors share, beside the checkpoints."""
    return f"{_shared(spark).rstrip('/')}/scratch-{uuid.uuid4()}"


def dropped(spark: SparkSession, path: str) -> None:
    """Delete ``path``, with what lies below it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests on one machine) a
    temporary folder is made.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def within(spark: SparkSession, seconds: float, action: Callable):
    """``(True, result)`` of ``action``, or ``(False, message)`` if it fails or its jobs run longer than ``seconds``.

    Only jobs that ``action`` starts are cancelled.
    """
    sc, tag = spark.sparkContext, f"within-{uuid.uuid4()}"
    sc.addJobTag(tag)
    timer = threading.Timer(seconds, lambda: sc.cancelJobsWithTag(tag))
    timer.start()
    try:
        return True, action()
    except Exception as e:  # whatever the statement did wrong is its result
        return False, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
