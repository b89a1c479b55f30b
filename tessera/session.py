"""Sessions with the settings that the library's results depend on or profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Zone-less results need a fixed zone; the rest lets Spark choose joins and partitions by what it measures at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.inMemoryColumnarStorage.partitionPruning": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Names under which callers know these settings, and Spark's for the same thing.
TUNABLES = {
    "scan_task_batch_size": "spark.sql.files.maxPartitionBytes",
    "hash_partition_bytes": "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "max_broadcast_join_size": "spark.sql.autoBroadcastJoinThreshold",
    "max_build_hash_table_bytes": "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold",
    "enable_dynamic_filter_pushdown": "spark.sql.optimizer.runtime.bloomFilter.enabled",
    "enable_pinned_zone_map_pruning": "spark.sql.inMemoryColumnarStorage.partitionPruning",
    "sort_sample_bytes": "spark.sql.execution.rangeExchange.sampleSizePerPartition",
    "concat_batch_bytes": "spark.sql.adaptive.coalescePartitions.minPartitionSize",
    "enable_dynamic_zone_map_filter": "spark.sql.optimizer.dynamicPartitionPruning.enabled",
    "pin_table_compression": "spark.sql.inMemoryColumnarStorage.compressed",
}


def load_settings(path: str) -> dict[str, str]:
    """A configuration file's lines of `name: value` or `name = value`; # starts a comment."""
    out = {}
    with open(path) as f:
        for n, line in enumerate(f, 1):
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            mark = min((i for i in (line.find(":"), line.find("=")) if i > 0), default=-1)
            if mark < 0:
                raise ValueError(f"{path}, line {n}: a setting is name: value")
            out[line[:mark].strip()] = line[mark + 1 :].strip().strip("'\"")
    return out


def build_session(master: str | None = None, name: str = "tessera", config_file: str | None = None, **conf: object) -> SparkSession:
    """A session with DEFAULTS, then those of config_file, then conf: Spark's names with dots as double underscores, or those of TUNABLES."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in (load_settings(config_file) | conf if config_file else conf).items():
        builder = builder.config(TUNABLES.get(key, key.replace("__", ".")), str(value))
    return builder.getOrCreate()


def set_option(spark: SparkSession, name: str, value: object) -> None:
    spark.conf.set(TUNABLES.get(name, name), str(value).lower() if isinstance(value, bool) else str(value))


def reset_option(spark: SparkSession, name: str) -> None:
    spark.conf.unset(TUNABLES.get(name, name))
