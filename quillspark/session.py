"""Session helpers shared by every part of the library."""
from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "quillspark", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session it hands out."""
    base = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    return attach(builder.config(map={**base, **conf}).getOrCreate())


# Rows of the main tables hold whole texts: Spark's 10,000 rows a batch would be tens of megabytes several times over.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def attach(spark: SparkSession) -> SparkSession:
    """Lets Python workers that share this file system import the package; elsewhere ship it with --py-files.

    Arrow batches are kept small unless the session says otherwise."""
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "2000")
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new one only where that is unset on one machine (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its plan is cut, and no task of it runs twice."""
    path = f"{shared_dir(df.sparkSession)}/quillspark/{name}-{uuid.uuid4().hex}"
    temporary(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def step(spark: SparkSession, name: str) -> Iterator[str]:
    """A name for folders of what is written within a step of a loop; all of it goes with the step."""
    inner = f"{name}-{uuid.uuid4().hex}"
    temporary(spark, f"{shared_dir(spark)}/quillspark/{inner}")
    yield f"{inner}/"
    removed(spark, f"{shared_dir(spark)}/quillspark/{inner}")


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder that no frame in use reads."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_temporary: list[tuple[SparkSession, str]] = []


def temporary(spark: SparkSession, path: str) -> None:
    """A folder that goes when the program ends, or with given_back()."""
    if not _temporary:
        atexit.register(given_back)
    _temporary.append((spark, path))


def given_back() -> None:
    """Removes what was written between steps; frames that read it can't be used afterwards."""
    for spark, path in _temporary:
        removed(spark, path)
    _temporary.clear()


def published(df: DataFrame, path: str) -> None:
    """df written as Parquet beside the path, then moved there: whoever lists the path sees all of it or nothing; what stands there stays."""
    spark = df.sparkSession
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillspark/unpublished-{uuid.uuid4().hex}")
    df.write.parquet(made.toString())
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(to.getParent())
    if files.exists(to) or not files.rename(made, to):
        files.delete(made, True)
        if not files.exists(to):
            raise OSError(f"{path} could not be published")


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that have been published under a path, by name.

    They are read by name: two reads of one path at different times are one read to the planner, which would use the first for both."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in files.listStatus(at) if s.isDirectory()) if files.exists(at) else []


# A task of joins and aggregates by one key holds what it reads several times over, uncompressed: Spark's 64 MB of shuffled bytes
# a task would be gigabytes. The number of partitions before coalescing must follow the input for that.
SHARE, SHARE_MB = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 12
PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shared_out(spark: SparkSession, path: str) -> None:
    """Lets shuffles of an input be dealt to tasks of SHARE_MB, unless the session says how much a task reads.

    More partitions than the session names are only made where adaptive execution joins small ones again."""
    if spark.conf.get(SHARE, None) in (None, "67108864b", f"{SHARE_MB}m"):
        spark.conf.set(SHARE, f"{SHARE_MB}m")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        length = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        known = int(spark.conf.get(PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(PARTS, str(max(known, 2 * length // (SHARE_MB << 20))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read where only Spark may be able to reach it."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    shared_out(spark, path)
    return spark.read.parquet(path)
