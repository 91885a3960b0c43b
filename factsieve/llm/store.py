"""Tables in the folder that all executors share, and batches that go to Python.

Long jobs cut their lineage by writing a Parquet table below ``spark.checkpoint.dir``;
a lost executor then costs the tasks of one step. Only a session on one machine
(``local[...]``) may leave the setting out; it gets a temporary folder.
"""

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark's setting to delete the shuffle files of a statement when it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Spark's bound on the bytes of a batch that goes to Python, 64 MB unless set.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="factsieve-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def share_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_factsieve_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(prefix="factsieve-code-"), f"{package.name}-code.zip")
    with zipfile.ZipFile(name, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(name)
    context._factsieve_sent = True


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Send Python at most some megabytes at a time from now on, unless the session sets another bound.

    A batch stands in the executor and in its worker, on the way back once more, and workers keep
    the memory of the largest for the stages that follow.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(most))


class Scratch:
    """Intermediate tables of one job."""

    def __init__(self, spark: SparkSession, name: str):
        share_code(spark)
        self.spark = spark
        self.folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.folder}/{name}-{self._made}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the stored rows, all columns nullable."""
        path = self.path(name)
        # What the write shuffles is of no use after it, and else stays on the disks until the driver's
        # garbage collection comes upon it.
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored.scratch_path = path
        return stored

    def slim(self, df: DataFrame, name: str) -> DataFrame:
        """Store rows of ids and numbers alone. Partitions of them are small, and a file of each costs more
        than its rows: a task writes up to eight, as long as each core has four tasks."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.table(df.coalesce(max(-(-parts // 8), 4 * self.spark.sparkContext.defaultParallelism)), name)

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored tables that nothing will read any more."""
        for df in tables:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null texts are empty."""
    return text_of(name).cast("binary").alias("text")


def text_of(name: str = "text") -> Column:
    """A text column; null texts are empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias("text")


def only(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns; whatever else the table has cannot clash with a job's own names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def docs_of(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
