"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slot t of the schedule is the golden-ratio point frac(t * phi). Points fall through the cumulative target shares
of the sources, and the r-th slot of a source takes block r of its token line: its documents in hash order, started
again once all are used. A source's target is cut evenly into as many blocks as it has slots (one at least), so each
source's slots take its target to the word, however small it is and however many words the corpus has.

Scale: words are counted in one scan; all else is narrow rows. No step needs a source in one task: the order
within a source is built from hash buckets (sums per bucket, then a running sum within the bucket), and slots are
ranked by chunk of the schedule. The number of slots is a parameter and doesn't grow with the corpus; it bounds how
fine the sources alternate, not how much of each is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh_names

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SLOTS = 1 << 18
#: A source's line is laid out in buckets of about so many rows of the whole table.
BUCKET_ROWS = 1 << 16
MIN_BUCKETS = 256
CHUNK = 1 << 12
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """source, ord, source_size, weight, target of (source, source_size); shares by weight, capped at most_times the size.

    Reshared excess settles where target = min(cap, level * weight). Sources ordered by cap / weight are capped from
    the front; the level is fixed by the first one that isn't. There is one row per source throughout.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("ord", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * most_times)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "ord")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumns({"total": F.sum("source_size").over(whole), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(after)})
    free = F.col("cap") * F.col("open") > (F.col("total") - F.col("capped")) * F.col("weight")
    rows = rows.withColumn("free", free)
    rows = rows.withColumns({"c": F.min(F.when(F.col("free"), F.struct("capped", "open"))).over(whole)})
    target = F.when(F.col("free"), F.col("weight") * (F.col("total") - F.col("c.capped")) / F.col("c.open")).otherwise(F.col("cap").cast("double"))
    return rows.select("source", "ord", "source_size", "weight", target.cast("double").alias("target"))


def schedule(targets: DataFrame, slots: int = SLOTS, chunk: int = CHUNK) -> DataFrame:
    """(t, ord, rank): the source of each slot and the slot's rank among those of its source, both from 0."""
    spark = targets.sparkSession
    up_to = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = targets.select("ord", "target", F.sum("target").over(up_to).alias("high"), F.sum("target").over(Window.partitionBy()).alias("all"))
    shares = shares.where("`all` > 0 AND target > 0").select("ord", ((F.col("high") - F.col("target")) / F.col("all")).alias("low"), (F.col("high") / F.col("all")).alias("high"))
    cells = 4096
    shares = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    points = spark.range(slots).select(F.col("id").alias("t"), ((F.col("id") * GOLDEN) % 1.0).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * cells))
    hit = points.join(shares, "cell").where("x >= low AND x < high").select("t", "ord", F.floor(F.col("t") / chunk).alias("chunk"))
    counts = hit.groupBy("ord", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("ord").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("ord", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("off"))
    inner = F.row_number().over(Window.partitionBy("ord", "chunk").orderBy("t")) - 1
    return hit.withColumn("i", inner).join(offsets, ["ord", "chunk"]).select("t", "ord", (F.col("off") + F.col("i")).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, slots: int = SLOTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, text_hash.

    Null texts count as empty (size 0, taken 0); a null source is a source of its own, ordered last; an empty table
    gives an empty result. Repeated rows each hold their own place in the token line. taken never exceeds most_times
    the size, as a line starts at most most_times times. Other columns aren't read. Equal inputs give equal results.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    rows = scratch.keep(rows.withColumn("h", F.xxhash64("doc_id", "text_hash")), "rows")
    buckets = max(MIN_BUCKETS, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = scratch.keep(sums, "sums")
    targets = scratch.keep(source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most_times), "targets")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    whole = F.least(F.floor(F.col("target") + F.lit(0.5)), F.col("source_size") * most_times)
    goals = targets.select("ord", whole.cast("long").alias("goal")).where("goal > 0")
    block = max(1, -(-total // slots))
    drawn = schedule(targets, -(-total // block), CHUNK).select("ord", "rank")
    missed = goals.join(drawn.select("ord").distinct(), "ord", "left_anti").select("ord", F.lit(0).cast("long").alias("rank"))
    drawn = scratch.keep(drawn.unionByName(missed), "drawn")
    goals = scratch.keep(goals.join(drawn.groupBy("ord").agg(F.count(F.lit(1)).alias("n")), "ord"), "goals")
    blocks = drawn.join(goals, "ord").select("ord", "rank", F.expr("rank * goal div n").alias("from"), F.expr("(rank + 1) * goal div n").alias("to"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("off", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("source", "bucket", "off")
    named = targets.join(goals, "ord", "left").select(F.col("source").alias("s"), "ord", "source_size", "target", "goal", "n")
    places = offsets.join(named, F.col("source").eqNullSafe(F.col("s"))).select("source", "bucket", "off", "ord", "source_size", "target", "goal", F.col("n").alias("n_blocks"))
    places = places.withColumnsRenamed({"source": "ps", "bucket": "pb"})
    placed = rows.join(places, F.col("source").eqNullSafe(F.col("ps")) & (F.col("bucket") == F.col("pb")))
    run = Window.partitionBy("ord", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("start", F.col("off") + F.sum("size").over(run) - F.col("size"))
    placed = scratch.keep(placed.select("doc_id", "ord", "size", "source_size", "target", "goal", "n_blocks", "start", "text_hash"), "placed")
    # A document stands in the endless line once a round; word p of it is in the last block that starts at p or before.
    rounds = placed.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most_times - 1))))
    rounds = rounds.withColumn("at", F.col("round") * F.col("source_size") + F.col("start")).where("at < goal")
    rounds = rounds.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("goal")))
    first, last = F.expr("((at + 1) * n_blocks - 1) div goal"), F.expr("(end * n_blocks - 1) div goal")
    parts = rounds.select("ord", "start", "size", "at", "end", F.explode(F.sequence(first, last)).alias("rank"))
    inside = F.greatest(F.least("end", "to") - F.greatest("at", "from"), F.lit(0))
    taken = parts.join(blocks, ["ord", "rank"]).groupBy("ord", "start", "size").agg(F.sum(inside).alias("taken"))
    out = placed.join(taken, ["ord", "start", "size"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "text_hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as often as the mix takes them (words taken over size, rounded to whole documents).

    Documents that it takes less than half of go, and so do those without words, null texts among them: a mix of words holds
    none of theirs. Rows that repeat, id and text, share what all of them take, each rounded up. Null ids and sources are
    values like others; an empty table gives an empty one; other columns stay as they are.
    """
    cols = docs.columns
    key, id_, hash_, times, copy = fresh_names(docs, "key", "id", "hash", "times", "copy")
    taken = mix(docs, id_col, text_col, source_col).withColumn("copies", F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + F.lit(0.5)))
    taken = taken.where("size > 0").groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = taken.where("copies > 0").select(id_, hash_, F.ceil(F.col("copies") / F.col("rows")).alias(times))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = keyed.join(taken, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(hash_)))
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*cols)
