"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings every report assumes. Time zone pins the LTZ<->NTZ casts that
# streaming needs (withWatermark only takes TIMESTAMP); AQE re-plans joins and
# coalesces shuffle partitions from runtime sizes; skew join splits hot keys.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # a page's keys (500 at most) are compared with row-group statistics one
    # by one, not as a range from the smallest to the largest
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
    # streaming state (per-conversation rollups, dedup ids) lives in RocksDB
    # on local disk instead of the executor heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Sizing for a large cluster (on the order of 100 TB of messages, ~1000
# executors). Scan splits of 512 MB keep the task count, and the number of
# partial top-k results a page merges, in the low hundreds of thousands. AQE
# starts from many shuffle partitions and coalesces them towards 256 MB, so
# a partition fits in executor memory without hand-tuning per report, and a
# partition over 1 GB and 5x the median is split as skewed.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.shuffle.partitions": "8192",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def build_session(master: str | None = None, app_name: str = "chatlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None,
                  profile: str = "local") -> SparkSession:
    """Create (or fetch) a session with the library's recommended settings.

    ``profile="cluster"`` adds ``CLUSTER_CONF`` (large-data sizing).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(RECOMMENDED_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    elif profile != "local":
        raise ValueError(f"profile must be local or cluster, not {profile!r}")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Read from ``spark.checkpoint.dir`` (session conf) or the SparkContext's
    checkpoint directory. Raises when neither is set: jobs must never fall
    back to a machine-local temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        raise RuntimeError(
            "no checkpoint folder: set spark.checkpoint.dir to a shared path "
            "(or call spark.sparkContext.setCheckpointDir)")
    return path.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """Use the configured checkpoint folder; only if none is set (tests and
    local runs), set ``default`` or else a folder below the session's warehouse,
    which a cluster shares too."""
    try:
        return checkpoint_root(spark)
    except RuntimeError:
        if default is None:
            default = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", default)
        spark.sparkContext.setCheckpointDir(default)
        return checkpoint_root(spark)


def materialize(df, cluster_by: str | None = None):
    """Compute ``df`` once for several later uses and cut its lineage.

    Always written as parquet to the shared checkpoint folder (sorted by
    ``cluster_by`` within range partitions when given), so that later reads
    prune columns and row groups and a lost executor does not re-trigger the
    work. Raises when the session names no such folder.
    """
    path = f"{checkpoint_root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    if cluster_by:
        df = df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
