"""What the operators of this folder share: the shared folder, tables and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20

#: Estimated bytes, and rows, of a file of a spooled table.
FILE_BYTES, FILE_ROWS = 32 << 20, 1 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Keep the session's Arrow batches small, so that a worker holds a few MB of text, not all of a
    partition; the setting holds for the session, as a query is run after it is built."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.  Where none is set a
    folder of our own will do only if driver and executors are one process: elsewhere that raises."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("turnwise.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="turnwise-")
        spark.conf.set("turnwise.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is there is deleted when this process ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_delete_left)
    _left[at] = spark
    return at


def spool(df: DataFrame, name: str, rows: int | None = None, as_is: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost
    executor loses nothing of it.

    Small tables are written by as many tasks as there are cores, not one file for each shuffle
    partition: by the planner's estimate of bytes, or by a bound of rows where a join makes that
    useless.  Large ones keep their partitions, and so does what is given as_is: a task then works
    on one partition, as code needs that counts on its partition's number, and as suits a table
    that is dear to make."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if as_is:
        df.write.parquet(path)
    else:
        size = rows // FILE_ROWS if rows is not None else int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // FILE_BYTES
        df.coalesce(max(spark.sparkContext.defaultParallelism, min(size, 1 << 24))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def discard(*spooled: DataFrame) -> None:
    """Delete spooled tables that no plan still to be run reads."""
    for df in spooled:
        _delete(df._spooled)


@contextlib.contextmanager
def scratch():
    """What is spooled inside is deleted at the end, but for tables given to keep()."""
    before, kept = set(_left), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._spooled)
        return df

    yield keep
    for path in [p for p in _left if p not in before and p not in kept]:
        _delete(path)


#: Paths that this process has written and not deleted, and their sessions.
_left: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _left.pop(path)
    jvm = spark.sparkContext._jvm or spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _delete_left() -> None:
    for path in list(_left):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(path)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted name one that no column of df has (case is ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
