"""Tables of a folder of Parquet files, and readers and writers of single tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """tables.orders is the DataFrame of <folder>/orders.parquet, a file or a folder of files; nothing is read before use."""

    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...] = NAMES):
        self.spark, self.folder, self.names = spark, folder.rstrip("/"), names

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.names:
            raise AttributeError(name)
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet")

    def register(self, *names: str) -> None:
        """Temporary views of the named tables, or of all."""
        for name in names or self.names:
            getattr(self, name).createOrReplaceTempView(name)


def read_parquet(spark: SparkSession, *paths: str, hive_partitioning: bool = True, merge_schema: bool = False) -> DataFrame:
    """Files, folders or globs, local or of any store Hadoop reads (s3a://, hdfs://). key=value folders give columns.

    merge_schema reads every file's footer for its columns; else the files are taken to have those of one.
    """
    reader = spark.read.option("mergeSchema", "true") if merge_schema else spark.read
    if not hive_partitioning:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.parquet(*(_store(p) for p in paths))


def read_csv(spark: SparkSession, *paths: str, schema: str, header: bool = True, **options: str) -> DataFrame:
    """Delimited text with a declared schema: inferring one would read the files twice."""
    return spark.read.options(header=str(header).lower(), **options).schema(schema).csv([_store(p) for p in paths])


def read_json(spark: SparkSession, *paths: str, schema: str, **options: str) -> DataFrame:
    return spark.read.options(**options).schema(schema).json([_store(p) for p in paths])


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error", max_records: int = 0) -> None:
    """COPY TO and, with mode="append", INSERT. Rows are dealt out by the partition columns first: a file per task and value."""
    writer = df.write
    if partition_by:
        writer = df.repartition(*partition_by).write.partitionBy(*partition_by)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.mode(mode).parquet(_store(path))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", "true").csv(_store(path))


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(_store(path))


def _store(path: str) -> str:
    """Hadoop's name for object-store paths."""
    return "s3a://" + path.split("://", 1)[1] if path.startswith(("s3://", "s3n://")) else path
