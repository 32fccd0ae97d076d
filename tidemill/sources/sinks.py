"""Sinks that can be repeated: batches of a stream under their ids, runs that stop, audit events of one schema, a keyed store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The schema of audit events and their kinds.
AUDIT = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("payload", T.StringType())])
KINDS = ("message", "reply", "tool_call", "approval_requested", "approval_decided", "error", "session_closed")
#: Infrastructure errors in a row that end a run.
FAILURES = 3


class RunStopped(RuntimeError):
    """A run's episodes failed too often in a row."""


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def batches(path: str, check: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes each batch below ``path`` under its id. A batch that comes again replaces itself, so it adds
    nothing; ``check`` sees all that was written so far and may stop the stream by raising."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if check:
            check(batch.sparkSession.read.parquet(path))

    return write


def stop_after(order: list[str], failures: int = FAILURES, status: str = "status") -> Callable[[DataFrame], None]:
    """A check that raises ``RunStopped`` once the last ``failures`` episodes, in order, are all infrastructure errors."""

    def check(episodes: DataFrame) -> None:
        last = episodes.orderBy(*(F.desc(c) for c in order)).limit(failures).select(status).collect()
        if len(last) == failures and all(r[0] == "infra_error" for r in last):
            raise RunStopped(f"the last {failures} episodes failed")

    return check


def audit_events(events: DataFrame) -> DataFrame:
    """Events in the schema of the audit, payloads as JSON. Other kinds than KINDS, and events without session or time, are errors."""
    payload = F.col("payload") if isinstance(events.schema["payload"].dataType, T.StringType) else F.to_json("payload")
    bad = F.col("session_id").isNull() | F.col("at").isNull() | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    kind = F.when(bad, F.raise_error(F.concat(F.lit("no audit event: "), F.coalesce("kind", F.lit("null"))))).otherwise(F.col("kind"))
    return events.select(F.col("session_id").cast("string").alias("session_id"), F.col("at").cast("timestamp").alias("at"), kind.alias("kind"), payload.alias("payload")).to(AUDIT)


def fill(keys: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], parts: int = 16) -> int:
    """Adds to the store at ``path`` (key, *values) what ``compute`` gives for those keys (key, ...) that it lacks, each once, and
    tells how many these were. Keys are dealt over ``parts`` folders, of which only those with new keys are written to."""
    spark = keys.sparkSession
    wanted = keys.dropDuplicates(["key"]).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    if _there(spark, path):
        wanted = wanted.join(spark.read.parquet(path).select("part", "key"), ["part", "key"], "left_anti")
    wanted = wanted.cache()
    try:
        missing = wanted.count()
        if missing:
            found = compute(wanted.drop("part")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
            found.write.partitionBy("part").mode("append").parquet(path)
        return missing
    finally:
        wanted.unpersist()


def lookup(keys: DataFrame, path: str, parts: int = 16) -> DataFrame:
    """``keys`` (key, ...) with what the store holds of them; null where it holds nothing."""
    store = keys.sparkSession.read.parquet(path)
    asked = keys.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    return asked.join(store, ["part", "key"], "left").drop("part")
