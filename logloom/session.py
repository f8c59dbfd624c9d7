"""Session settings, and shipping the package to Python workers."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: weakref.WeakSet = weakref.WeakSet()

#: Bytes of an Arrow batch, an eighth of Spark's own default: a worker holds its input, its
#: output and what lies between several times over.
ARROW_BATCH = 8 << 20

#: Settings that every plan of this library is written for.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BATCH),
}


def build_session(app: str = "logloom", **conf: str) -> SparkSession:
    """A session with ``DEFAULTS``; other settings by dotted name, as ``**{...}``."""
    return SparkSession.builder.appName(app).config(map=DEFAULTS | conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a context, so that workers can import it.

    Also lowers the size of Arrow batches to ``ARROW_BATCH`` where it is at Spark's default.
    """
    sc = spark.sparkContext
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, "67108864b") == "67108864b":
        spark.conf.set(size, str(ARROW_BATCH))
    if sc not in _SHIPPED:
        root = Path(__file__).resolve().parent
        fd, name = tempfile.mkstemp(prefix="logloom-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(name)
        _SHIPPED.add(sc)
    return spark


def trim(spark: SparkSession) -> None:
    """Have the executors collect their garbage, a task a core, so that a heap that earlier work filled shrinks.

    A heap isn't made smaller else, and counts beside the Python workers of whatever comes
    next. Results don't depend on it, nor on whether a busy executor is reached.
    """
    n = spark.sparkContext.defaultParallelism
    call = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(call.alias("done")).write.format("noop").mode("overwrite").save()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all runs on this machine (as in local tests) a temporary one
    is made; on a cluster its absence raises, since executors don't share a driver's folders.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="logloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


_SCRATCH = threading.local()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from its reliable checkpoint in the shared folder.

    The estimates of the plan so far are left behind too: a join's is the product of its
    sides', and over a loop of joins these numbers grow to more digits than can be multiplied.
    """
    spark = df.sparkSession
    shared_dir(spark)
    plan = df.checkpoint(eager=True)._jdf.logicalPlan()
    for made in getattr(_SCRATCH, "open", []):
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            made.append(file.get())
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), plan.schema(), False), spark)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reaches is a folder."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reaches, if it is there."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Small tables that one piece of work needs, as Parquet in the shared folder until its end.

    ``put`` computes a table once, as ``cut`` does. A checkpoint runs its last stage twice and
    keeps a file and a task for each partition ever after, however empty; these tables are
    written at once, empty partitions leave no file, and a reader puts small files together
    and knows their size. What is returned from the work has to be computed within.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.made = spark, f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.base)

    def put(self, df: DataFrame) -> DataFrame:
        path, self.made = f"{self.base}/{self.made}", self.made + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


#: Spark's own setting: the shuffle files of a query are deleted when it ends.
TIDY_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made and run within delete their shuffle files at their end.

    Else these stay until the driver happens to collect its garbage, which many steps over
    small tables hardly make it do, while each of their tasks leaves three files.
    """
    was = spark.conf.get(TIDY_SHUFFLES, None)
    spark.conf.set(TIDY_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY_SHUFFLES) if was is None else spark.conf.set(TIDY_SHUFFLES, was)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the checkpoints that this thread's ``cut`` made within.

    What is computed from them must be written by then.
    """
    stack = _SCRATCH.open = getattr(_SCRATCH, "open", [])
    stack.append(made := [])
    try:
        yield
    finally:
        stack.remove(made)
        for path in made:
            remove(spark, path)
