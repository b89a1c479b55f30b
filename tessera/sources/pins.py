"""Named tables held resident: chosen columns of a source, persisted and served to later queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .tables import read_parquet

#: Where a pinned table lives: memory alone (rebuilt if evicted), memory then disk, or disk.
TIERS = {"memory": StorageLevel.MEMORY_ONLY, "host": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY}


@dataclass
class Pin:
    name: str
    path: str | None
    columns: tuple[str, ...]
    data: DataFrame
    files: frozenset[str] = frozenset()
    whole: bool = False


class Pins:
    """A registry of pinned tables. Columnar batches keep their least and greatest values, which prune as filters apply."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: dict[str, Pin] = {}

    def pin(self, source: str | DataFrame, name: str | None = None, cols: list[str] | None = None, tier: str = "host", eager: bool = False) -> DataFrame:
        """Holds cols (all if None) of a Parquet path or a DataFrame as the view name. Pinning a name again replaces it."""
        path = source if isinstance(source, str) else None
        df = read_parquet(self.spark, path) if path is not None else source
        name = name or (path.rstrip("/").rsplit("/", 1)[-1].split(".")[0] if path else None)
        if not name:
            raise ValueError("a DataFrame is pinned by name")
        if tier not in TIERS:
            raise ValueError(f"unknown tier {tier!r}: one of {', '.join(TIERS)}")
        held = (df.select(*cols) if cols else df).persist(TIERS[tier])
        if name in self._held:
            self.unpin(name)
        held.createOrReplaceTempView(name)
        self._held[name] = Pin(name, path, tuple(held.columns), held, frozenset(df.inputFiles() if path else ()), len(held.columns) == len(df.columns))
        if eager:
            held.count()
        return held

    def scan(self, source: str, cols: list[str] | None = None) -> DataFrame:
        """The pinned table of this name or of the same files if it holds the columns, else the files themselves."""
        if source in self._held and set(cols or ()) <= set(self._held[source].columns):
            held = self._held[source]
            return held.data.select(*(cols or held.columns))
        df = read_parquet(self.spark, source)
        files = frozenset(df.inputFiles())
        for p in self._held.values():
            if p.path is not None and files == p.files and set(cols or df.columns) <= set(p.columns):
                return p.data.select(*(cols or df.columns))
        return df.select(*cols) if cols else df

    def of_files(self, paths: list[str]) -> DataFrame | None:
        """The pinned table that holds all columns of just these files, however their paths are written; else None."""
        wanted = None
        for p in self._held.values():
            if p.path is None or not p.whole:
                continue
            wanted = wanted or set(read_parquet(self.spark, *paths).inputFiles())
            if wanted == p.files:
                return p.data
        return None

    def unpin(self, name: str) -> None:
        self._held.pop(name).data.unpersist()
        self.spark.catalog.dropTempView(name)

    def path_of(self, name: str) -> str | None:
        return self._held[name].path if name in self._held else None

    def names(self) -> list[str]:
        return sorted(self._held)
