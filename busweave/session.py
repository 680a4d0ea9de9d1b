"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with the library's defaults; ``extra`` overrides them."""
    builder = SparkSession.builder.appName("busweave")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset in a local session, a temporary one that goes with
    the process; a cluster without it is refused, as a folder of one machine is none of the others'."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        folder = tempfile.mkdtemp(prefix="busweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders of steps this process has written and not yet removed.
_steps: list[str] = []
_at_exit: list = []


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends in files every executor can read again.

    The files stay until ``clear_steps``, as results are read lazily; at the latest they go when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _at_exit:
        _at_exit.append(atexit.register(clear_steps, spark))
    _steps.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_steps(spark: SparkSession) -> int:
    """Removes the steps written so far, and gives their number. Frames built on them can't be read any more: call it between jobs.

    A session that has ended removes nothing but local folders.
    """
    done = 0
    while _steps:
        path = _steps.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone when the process ends
            if "://" in path and not path.startswith("file:"):
                continue
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        done += 1
    return done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
