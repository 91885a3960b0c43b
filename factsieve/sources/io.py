"""Readers and writers for requests, token batches and verdicts."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factsieve.sources import schemas


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Finished answers to verify, with a fixed schema (no inference pass)."""
    return spark.read.schema(schemas.REQUESTS).format(fmt).load(path)


def read_token_batches(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: str = schemas.TOKEN_BATCHES,
    max_files_per_trigger: int | None = 64,
    max_bytes_per_trigger: int | str | None = None,
) -> DataFrame:
    """A stream of text deltas and token ids from files that keep arriving.

    ``max_files_per_trigger`` bounds the files of a micro-batch (None: all there are);
    ``max_bytes_per_trigger`` (a number, or text such as ``512m``) bounds their bytes instead: files are admitted
    while their sum stays below it, and one larger file comes alone. Files must arrive in ``seq``
    order per session. Another source (Kafka, say) with the same columns works alike.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    elif max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def write_verdicts(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Store verdicts partitioned by outcome, so readers of failures skip the rest."""
    df.write.mode(mode).format(fmt).partitionBy("passed").save(path)


def write_verdict_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    available_now: bool = False,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Start appending stream verdicts; exactly once per checkpoint folder."""
    writer = df.writeStream.outputMode("append").format(fmt).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time is not None:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one the session names in ``spark.checkpoint.dir``.

    Without that setting only a session on one machine gets a folder, a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="factsieve-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Setting of a session: deal the rows of every table read by :func:`read_table` to so many tasks.
PARTITIONS = "spark.factsieve.partitions"


def read_table(spark: SparkSession, folder: str, name: str, partitions: int | None = None) -> DataFrame:
    """One parquet table of a folder.

    A scan cannot divide a row group, so a file with one huge row group keeps one task busy.
    ``partitions``, or the setting ``spark.factsieve.partitions``, deals the rows out before
    anything costly, whatever their number; without either the scan's own tasks are used.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    partitions = partitions or int(spark.conf.get(PARTITIONS, "0"))
    return table.repartition(partitions) if partitions else table
