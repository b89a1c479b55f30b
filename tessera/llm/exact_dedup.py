"""Exact duplicates by distributed MSD radix partitioning.

A text is read as its length (the most significant digit) and then its UTF-8 bytes. Each round splits every
open group by the next bytes of its members; a group that becomes a singleton is closed, as is one whose
texts have ended. Equality is decided by the bytes alone, never by a digest. Digits widen by ``GROWTH`` each
round, so that a text of n bytes takes O(log n) rounds.

Scale: the first round counts digits with map-side partial aggregation, and only texts that share their first
digit with another are carried on. A hot group of copies is one counted row per task; the joins that name
groups are sort-merge joins with one row per group on the other side, whose large partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, fresh_names

FIRST_BYTES = 32
GROWTH = 16


def _digit(raw: Column, start: int, width: int) -> Column:
    return F.substring(raw, start + 1, width)


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """One row per input row: (<id_col>, n_bytes, sha256, rid, gid, group_size, keep_id, keep_rid).

    gid is null for a text that no other row has. keep_id is the largest id of the group (a null id is smaller
    than any other), keep_rid tells repeated rows of one id apart, so that exactly one row of a group stays.
    A null text counts as empty; an empty table gives an empty result. Other columns are not read, so their
    names may be anything.
    """
    scratch = Scratch(docs.sparkSession, "radix")
    raw = F.coalesce(F.col("t"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).select("id", raw.alias("raw"))
    rows = rows.withColumns({"n_bytes": F.octet_length("raw"), "digit": _digit(F.col("raw"), 0, first_bytes)})
    # Written before the join, so that it is a join of two shuffles: then AQE splits the partition of a hot group.
    shared = scratch.keep(rows.groupBy("n_bytes", "digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n_bytes", "digit", F.lit(True).alias("more")), "shared")
    first = rows.select("id", "raw", "n_bytes", "digit", F.sha2("raw", 256).alias("sha256")).join(shared.hint("merge"), ["n_bytes", "digit"], "left")
    first = first.select("id", "n_bytes", "sha256", F.coalesce("more", F.lit(False)).alias("open"), F.when(F.col("more"), F.col("raw")).alias("raw"), F.monotonically_increasing_id().alias("rid"), F.when(F.col("more"), F.col("digit")).alias("digit"))
    first = scratch.keep(first, "first")
    open_rows = first.where("open").select("id", "rid", "raw", "n_bytes", "digit")
    groups = scratch.keep(open_rows.groupBy("n_bytes", "digit").agg(F.count(F.lit(1)).alias("n")).select("n_bytes", "digit", F.monotonically_increasing_id().alias("gid")), "groups0")
    now = scratch.keep(open_rows.join(groups.hint("merge"), ["n_bytes", "digit"]).select("id", "rid", "raw", "n_bytes", "gid"), "open0")
    ended, start, width, level = [], first_bytes, first_bytes * growth, 0
    while True:
        done = now.where(F.col("n_bytes") <= start).select("id", "rid", "gid", F.lit(level).alias("level"))
        ended.append(done)
        left = now.where(F.col("n_bytes") > start).withColumn("digit", _digit(F.col("raw"), start, width))
        if left.isEmpty():
            break
        level += 1
        split = left.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        split = scratch.keep(split.select("gid", "digit", F.monotonically_increasing_id().alias("next")), f"groups{level}")
        now = scratch.keep(left.join(split.hint("merge"), ["gid", "digit"]).select("id", "rid", "raw", "n_bytes", F.col("next").alias("gid")), f"open{level}")
        start, width = start + width, width * growth
    members = ended[0]
    for more in ended[1:]:
        members = members.union(more)
    totals = members.groupBy("level", "gid").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "rid")).alias("top"))
    totals = scratch.keep(totals.where("group_size > 1").select("level", "gid", "group_size", F.col("top.id").alias("keep_id"), F.col("top.rid").alias("keep_rid")), "totals")
    grouped = members.join(totals.hint("merge"), ["level", "gid"]).select("rid", F.struct("level", "gid").alias("gid"), "group_size", "keep_id", "keep_rid")
    out = first.select("id", "n_bytes", "sha256", "rid").join(grouped.hint("merge"), "rid", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "sha256", "rid", "gid", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.when(F.col("gid").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_rid", "rid").alias("keep_rid"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. See radix_groups for nulls and ties."""
    g = radix_groups(docs, id_col, text_col)
    return g.select(F.col(id_col).alias("doc_id"), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha256").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the copies that exact_dedup drops, with their own columns.

    Rows are removed by (id, sha256) of dropped rows; of repeated rows with one id and text one stays.
    """
    cols = docs.columns
    key, id_, sha, some = fresh_names(docs, "key", "id", "sha", "some")
    d = exact_dedup(docs, id_col, text_col)
    lost = d.groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).agg(F.max("kept").alias(some), F.count(F.lit(1)).alias("times"))
    lost = lost.where(~F.col(some) | (F.col("times") > 1)).drop("times")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(sha))
    gone = keyed.join(lost, same, "left_anti")
    again = keyed.join(lost.where(some), same, "left_semi").dropDuplicates([id_col, key])
    return gone.unionByName(again).select(*cols)
