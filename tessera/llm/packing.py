"""Best-fit packing of tokenised documents into sequences by large-item matching.

Pieces above a third of the capacity go at most two to a bin: each, from the longest down, is matched with the
longest other large piece that still fits. The small pieces then go, longest first, to the fullest bin they fit.

Only lengths matter to the plan, and a length is at most the capacity: the driver packs a histogram of ``capacity``
counts, whatever the corpus. The plan is a list of bin patterns with the number of bins of each; pieces are ranked
within their length and take the plan's places in that order. No step sees the pieces of a length in one task:
ranks are built from hash buckets, whose number grows with the pieces, each with its offset. A rank finds its run of the
plan by an equi-join on the cell of the length's ranks that it lies in.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

CAPACITY = 2048
END_ID = 0
#: Pieces of a length are ranked in buckets of about so many rows of the whole table.
BUCKET_ROWS = 1 << 16
MIN_BUCKETS = 8
CELLS = 64
#: Texts with other characters, or the special token, are tokenised by the tokenizers library itself.
PLAIN = re.compile(r"[\x00-ɏ‐-‧]*")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of the byte-level BPE vocabulary; the tiktoken form of the same ranks serves plain texts, as it is faster."""

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(json_path)

    def ids(self, text: str) -> np.ndarray:
        if "<|" not in text and PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut only beyond the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json_path, ranks_path)
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens = np.append(encoder.ids(text.as_py() or ""), END_ID).astype("<u4")
                head = len(tokens) % capacity or capacity
                edges = [0, *range(min(head, len(tokens)), len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    ids.append(doc_id.as_py())
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, number of such bins): large-item matching, then best fit of the small, in runs of equal bins."""
    left = {n: c for n, c in histogram.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    bins: list[tuple[tuple[int, ...], int]] = []
    while large:
        top = large[-1]
        at = bisect.bisect_right(large, capacity - top) - 1
        if at < 0:
            bins.append(((top,), left.pop(top)))
            large.pop()
            continue
        mate = large[at]
        times = left[top] // 2 if mate == top else min(left[top], left[mate])
        if mate == top and left[top] == 1:
            if at == 0:
                bins.append(((top,), 1))
                left.pop(top)
                large.pop()
                continue
            mate, times = large[at - 1], 1
        if times:
            bins.append(((top, mate), times))
            for n in (top, mate):
                left[n] -= times
        for n in {top, mate}:
            if not left[n]:
                left.pop(n)
                large.remove(n)
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for lengths, times in bins:
        room[capacity - sum(lengths)].append((lengths, times))
    gaps = sorted(room)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                fresh, many = (), -(-count // (capacity // n))
                gap, run = capacity, (fresh, many)
            else:
                gap = gaps[at]
                run = room[gap].pop()
                if not room[gap]:
                    room.pop(gap)
                    gaps.pop(at)
            lengths, times = run
            each = min(gap // n, count)  # the fullest bin stays the fullest until n no longer fits
            used = min(times, count // each)
            for key, value in ((gap - each * n, (lengths + (n,) * each, used)), (gap, (lengths, times - used))):
                if value[1]:
                    if key not in room:
                        bisect.insort(gaps, key)
                    room[key].append(value)
            count -= each * used
    return [run for gap in sorted(room) for run in room[gap]]


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of its end id alone. Repeated rows are packed each; an empty table gives an
    empty result; a null doc_id stays null. Other columns aren't read. Which of equally long pieces lies where is left open.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "pack")
    cut = pieces(docs, json_path or vocabulary("byte_bpe_50k.json"), ranks_path or vocabulary("byte_bpe_50k.tiktoken"), capacity, id_col, text_col)
    cut = scratch.keep(cut.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    buckets = max(MIN_BUCKETS, -(-cut.count() // bucket_rows))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    counts = scratch.keep(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    slots: list[tuple[int, int, int, int, int, int, int]] = []  # length, cell, first rank, last, places a bin, first bin, first offset
    taken: dict[int, int] = defaultdict(int)
    first_bin = 0
    for lengths, times in plan(histogram, capacity):
        offset = 0
        for n in dict.fromkeys(lengths):
            each, r0 = lengths.count(n), taken[n]
            last = r0 + each * times - 1
            slots += [(n, cell, r0, last, each, first_bin, offset) for cell in range(r0 * CELLS // histogram[n], last * CELLS // histogram[n] + 1)]
            taken[n] = last + 1
            offset += n * each
        first_bin += times
    # A run of the plan stands in each cell of its length's ranks that it touches: at most CELLS rows a length beside one a run.
    runs = spark.createDataFrame(slots or [(0, 0, 0, 0, 1, 0, 0)], "length long, cell long, r0 long, r1 long, each long, bin0 long, off0 long")
    sizes = spark.createDataFrame(list(histogram.items()) or [(0, 1)], "length long, total long")
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).join(F.broadcast(sizes), "length")  # at most `capacity` rows
    inner = Window.partitionBy("length", "bucket").orderBy("rid")
    ranked = cut.withColumn("i", F.row_number().over(inner) - 1).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("i"))
    ranked = ranked.withColumn("cell", F.expr(f"rank * {CELLS} div total"))
    placed = ranked.join(runs, ["length", "cell"]).where("rank BETWEEN r0 AND r1").withColumn("k", F.col("rank") - F.col("r0"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin0") + F.floor(F.col("k") / F.col("each"))).cast("long").alias("sequence_id"), (F.col("off0") + F.pmod(F.col("k"), F.col("each")) * F.col("length")).cast("long").alias("offset"))
