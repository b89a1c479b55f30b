"""Tables written to the shared checkpoint folder, to cut lineage and keep costly results."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, shared_dir

_OWN: list[tuple[SparkSession, str]] = []


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def has_irregular_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether an id is null or stands twice."""
    counts = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return not counts.where("id IS NULL OR n > 1").isEmpty()


class Scratch:
    """Written tables of one operator call. keep() writes and rereads; drop() removes what no later step needs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"
        _OWN.append((spark, self.base))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.base}/{name}")


@atexit.register
def _clear() -> None:
    for spark, base in _OWN:
        try:
            delete(spark, base)
        except Exception:  # the session has ended already: the folder's owner clears it
            return
