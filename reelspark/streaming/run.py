"""Driving a streaming plan over everything that is available, into a stored table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.rollup import project_status, rollup_workflows
from ..session import storage_root

#: Added to the place of an expired task: its end comes after all that was known of its project.
LATER = 1 << 40


#: Typed state with timers needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for one stream: on a local master each shuffle partition is one state store per core.

    Settings of the given session stay as they are; a cluster keeps its own number of partitions.
    """
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        if (value := spark.conf.get(key, None)) is not None and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    cores = spark.sparkContext.defaultParallelism
    if spark.sparkContext.master.startswith("local[") and int(own.conf.get("spark.sql.shuffle.partitions")) > cores:
        own.conf.set("spark.sql.shuffle.partitions", str(cores))
    return own


def run_available(stream: DataFrame, spark: SparkSession, label: str = "stream") -> DataFrame:
    """Runs an append-mode stream with ``availableNow`` and returns the table it wrote, read by ``spark``.

    Output and progress live in the shared checkpoint folder, so a restarted query continues where it was.
    """
    base = f"{storage_root(spark)}/reelspark/{label}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def refresh_expired(
    expired: DataFrame, spark: SparkSession, tasks: DataFrame, goals: DataFrame, label: str = "refresh"
) -> tuple[DataFrame, DataFrame]:
    """Runs a stream of expired tasks on into workflows and projects: ``(workflow rows, project rows)`` that changed.

    ``expired``: task_id, heartbeat_ms, error (``expire_heartbeats``); ``tasks``: task_id, project_id, workflow_id, kind, goal, seq,
    status, error; ``goals``: workflow_id, goal, status, error, n_drafts.  Only running tasks are interrupted.  A micro-batch
    writes the tasks that expired in it, and then rolls up the workflows and projects that they belong to, with all
    tasks that have expired so far.  Every batch has its own folders and overwrites them, so one that is run again leaves the
    same tables; the row of a workflow or project is the one of its last batch.
    """
    base = f"{storage_root(spark)}/reelspark/{label}-{uuid.uuid4().hex}"
    marks = "task_id long, heartbeat_ms long, error string"

    def settled(batch: int) -> DataFrame:
        done = spark.read.schema(marks + ", batch int").parquet(f"{base}/expired").where(F.col("batch") <= batch)
        late = done.groupBy("task_id").agg(F.first("error").alias("late"), F.max("batch").alias("batch"))
        hit = F.col("late").isNotNull() & (F.col("status") == "running")
        return tasks.join(late, "task_id", "left").withColumns(
            {
                "batch": F.when(hit, F.col("batch")),
                "error": F.when(hit, F.col("late")).otherwise(F.col("error")),
                "seq": F.when(hit, F.col("seq") + LATER).otherwise(F.col("seq")),
                "status": F.when(hit, F.lit("interrupted")).otherwise(F.col("status")),
            }
        )

    def write(rows: DataFrame, batch: int) -> None:
        rows.select("task_id", "heartbeat_ms", "error").write.mode("overwrite").parquet(f"{base}/expired/batch={batch}")
        now = settled(batch)
        for key, made in (("workflow_id", lambda t: rollup_workflows(goals, t)), ("project_id", project_status)):
            touched = now.where(F.col("batch") == batch).select(key).distinct()
            after = made(now.drop("batch", "late")).join(touched, key, "left_semi")
            after.write.mode("overwrite").parquet(f"{base}/{key}/batch={batch}")

    query = (
        expired.writeStream.outputMode("append")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()

    def newest(key: str, rows: DataFrame) -> DataFrame:
        kept = StructType([*rows.schema.fields, StructField("batch", IntegerType())])
        versions = spark.read.schema(kept).parquet(f"{base}/{key}")
        last = versions.groupBy(key).agg(F.max("batch").alias("batch"))
        return versions.join(last, [key, "batch"], "left_semi").drop("batch")

    return newest("workflow_id", rollup_workflows(goals, tasks)), newest("project_id", project_status(tasks))


def run_updates(
    stream: DataFrame, spark: SparkSession, keys: list[str], version: str, label: str = "stream"
) -> DataFrame:
    """Runs an update-mode stream with ``availableNow`` and returns the newest row of every key.

    Each micro-batch overwrites its own folder, so a batch that is run again leaves the same table; ``version`` is a
    column that grows with every update of a key.
    """
    base = f"{storage_root(spark)}/reelspark/{label}-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    versions = spark.read.schema(stream.schema).parquet(f"{base}/out")
    newest = versions.groupBy(*keys).agg(F.max(version).alias(version))
    return versions.join(newest, [*keys, version], "left_semi")
