"""Session helpers: defaults for local runs, never overriding what a cluster sets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "reelspark") -> SparkSession:
    """Session for tests and bench.  On a cluster use the session you are given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def configured_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, if any."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Shared checkpoint folder; a temporary one only on a local master that names none."""
    configured = configured_root(spark)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="reelspark-ckpt-")


_LOCAL_ROOT: str | None = None


def storage_root(spark: SparkSession) -> str:
    """Folder for stored tables: the configured one, or one temporary folder per local process."""
    global _LOCAL_ROOT
    root = configured_root(spark)
    if root is None:
        _LOCAL_ROOT = _LOCAL_ROOT or checkpoint_root(spark)
        root = _LOCAL_ROOT
    return root.rstrip("/")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and read back.

    Cuts lineage between stages that several later steps read.  The files outlive lost executors, and
    readers still prune columns and push filters, which a row-based checkpoint could not.
    """
    spark = df.sparkSession
    path = f"{storage_root(spark)}/reelspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_session(spark: SparkSession) -> SparkSession:
    """A session of its own, with the given one's settings, for plans over ``materialize_by``.

    There a join on a key and more columns takes both sides as they lie, if both are dealt out by that key.  So the rows of a
    key must be bounded.
    """
    own = spark.newSession()
    for key, value in ((r["key"], r["value"]) for r in spark.sql("SET").collect()):
        if (key.startswith("spark.sql.") or key == "spark.checkpoint.dir") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def materialize_by(df: DataFrame, key: str, label: str = "table") -> DataFrame:
    """``materialize`` for a table whose rows later steps bring together by ``key``, or by it and more columns.

    Rows are dealt into files as a shuffle deals them into partitions, so aggregates, windows and, in a ``keyed_session``,
    joins read them where they lie and move none.  No entry stays in the catalog.
    """
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").bucketBy(parts, key)
    writer.option("path", f"{storage_root(spark)}/reelspark/{name}").saveAsTable(name)
    table = spark.read.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return table


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, dealt out for expensive row-local work.

    Large inputs already have many splits and pass through untouched, so no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
