"""Document fingerprints by MinHash over five-word shingles.

Every shingle is a 64-bit hash; PERMS multiply-shift functions of the universal family stand for permutations, and the
least value under each is a component of the signature. All texts of a slice are hashed together in numpy.
Signatures are joined on bands in Spark; candidates are verified by the exact Jaccard of their shingle sets.

Scale: fingerprinting is row-local. A document's neighbour is found in a range-partitioned order in which each task
streams its documents; what crosses a boundary is one document per partition.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, has_irregular_ids
from .shingles import SLICE_BYTES, WIDTH, sequence_hashes, shingle_sets, slices, word_hashes

PERMS = 192
BAND_ROWS = 6
TASK_BYTES = 16 << 20
THRESHOLD = 0.75
_A = np.random.default_rng(7).integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(8).integers(0, 1 << 63, 1024, dtype=np.uint64)
EMPTY = 0xFF


def signatures(texts: list[bytes], perms: int = PERMS, width: int = WIDTH) -> np.ndarray:
    """uint8 (texts, perms): a byte of each least value. A text without words has EMPTY in every component."""
    out = np.full((len(texts), perms), EMPTY, dtype=np.uint8)
    for a, b in slices(texts, SLICE_BYTES // 2):
        words, first = word_hashes(texts[a:b])
        every = sequence_hashes(words, width)
        parts, rows = [], []
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi > lo:
                parts.append(every[lo : hi - width + 1] if hi - lo >= width else sequence_hashes(words[lo:hi], int(hi - lo)))
                rows.append(a + i)
        if not rows:
            continue
        hashes = np.concatenate(parts)
        starts = np.append(0, np.cumsum([len(p) for p in parts])[:-1])
        value = np.empty_like(hashes)
        for k in range(perms):
            np.multiply(hashes, _A[k], out=value)
            value += _B[k]
            least = np.minimum.reduceat(value, starts)
            out[rows, k] = (least >> np.uint64(20)).astype(np.uint8)
    return out


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """An estimate of the Jaccard similarity of the shingle sets: the share of equal components, less what chance gives a byte."""
    return np.maximum(0.0, ((one == other).mean(axis=1) - 1 / 256) / (1 - 1 / 256))


def _printable(signature: np.ndarray) -> list[str]:
    return [base64.b64encode(row.tobytes()).decode() for row in signature]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], following: list[str], perms: int, own: np.ndarray | None = None, after: np.ndarray | None = None) -> list[pa.Array]:
    own = signatures([t.encode() for t in texts], perms) if own is None else own
    after = signatures([t.encode() for t in following], perms) if after is None else after
    edited = [_edit(t, f) for t, f in zip(texts, following, strict=True)]
    raw = [e.encode() for e in edited]
    changed = signatures(raw, perms)
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(_printable(own)), pa.array(_printable(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, after))]


def with_next(docs: DataFrame, perms: int = PERMS, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per document: FIELDS, with the next document's text spliced in as the edit.

    Documents are ordered by id (null first), repeated ids by text; after the last comes the first. A null text counts
    as empty: two empty texts are alike (1), an empty and another aren't (0). An empty table gives an empty result.
    Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of all documents but the partition's last; of it and of the first, what the neighbours need."""
        head = last = None
        part = TaskContext.get().partitionId()
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            size = [len(t) for t in all_texts]
            at = 0
            while at < len(all_ids):  # bounded slices, whatever the size of an Arrow batch
                end, chars = at, 0
                while end < len(all_ids) and (end == at or chars + size[end] <= 4 * SLICE_BYTES):
                    chars += size[end]
                    end += 1
                ids, texts = all_ids[at:end], all_texts[at:end]
                own = signatures([t.encode() for t in texts], perms)
                if head is None:
                    head = texts[0]
                if last is not None:
                    ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate([last[2], own])
                if len(ids) > 1:
                    made = _rows(ids[:-1], texts[:-1], texts[1:], perms, own[:-1], own[1:])
                    n = len(ids) - 1
                    yield pa.RecordBatch.from_arrays([*made, pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], [*names, "head", "tail", "part"])
                last = (ids[-1], texts[-1], own[-1:])
                at = end
        if last is not None:
            blank = [pa.array([last[0]], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([head]), pa.array([last[1]]), pa.array([part], pa.int64())], [*names, "head", "tail", "part"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    ordered = rows.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text")
    made = scratch.keep(ordered.mapInArrow(stream, FIELDS + ", head string, tail string, part long"), "made")
    # One row per task that had rows, in the order of the ranges: its last text meets the first one of the next such task.
    edges = made.where("tail IS NOT NULL").select("doc_id", "tail", "head", "part")
    order = Window.orderBy("part")  # over the tasks' numbers alone
    first = F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = edges.select("part", F.coalesce(F.lead("part").over(order), first).alias("after"))
    heads = edges.select(F.col("part").alias("after"), F.col("head").alias("following"))
    joined = edges.select("doc_id", "tail", "part").join(after, "part").join(heads, "after").select("doc_id", "tail", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays(_rows(ids, texts, following, perms), names)

    return made.where("tail IS NULL").select(*names).union(joined.mapInArrow(close, FIELDS))


def fingerprints(docs: DataFrame, perms: int = PERMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, signature binary) of every row; equal texts have equal signatures.

    A null text counts as empty, and texts without words have EMPTY throughout; repeated rows are signed each; a null id
    stays null; an empty table gives an empty result; other columns aren't read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = signatures([(t or "").encode() for t in batch.column(1).to_pylist()], perms)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in made], pa.binary())], ["doc_id", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, signature binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, perms: int = PERMS, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, near_id, jaccard): verified links, near_id the smaller; documents that share a band and are near are connected.

    Each document first meets the smallest id of its band buckets, then the leader by another order. Verified links are
    contracted after each pass; at last all members of a bucket that are in different components meet, so no pair that
    shares a band and is near stays in two. Pairs within a component needn't all be listed. An LSH search: pairs that
    share no band aren't found. Texts without words are near nothing, and so are rows without an id. Rows that share an id
    count as one document, the one with the least text; an empty table gives an empty result; other columns aren't read. A bucket of n documents that link to nobody costs
    its n (n - 1) / 2 pairs.
    """
    scratch = Scratch(docs.sparkSession, "near")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    if has_irregular_ids(docs, "doc_id"):
        docs = scratch.keep(docs.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "once")
    id_col, text_col = "doc_id", "text"
    signed = fingerprints(docs, perms, id_col, text_col).where(F.col("doc_id").isNotNull() & (F.col("signature") != F.lit(bytes([EMPTY] * perms))))
    size = band_rows
    bands = F.explode(F.array(*(F.struct(F.lit(b).alias("b"), F.substring("signature", b * size + 1, size).alias("v")) for b in range(perms // band_rows))))
    rows = scratch.keep(signed.select("doc_id", bands.alias("band")).select("doc_id", "band.b", "band.v"), "bands")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([(t or "").encode() for t in batch.column(i).to_pylist()] for i in (2, 3))
            shared = [(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in zip(shingle_sets(left), shingle_sets(right), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s / max(1, x + y - s) for s, x, y in shared])], ["doc_id", "near_id", "jaccard"])

    def passed(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """All pairs of a pass and the verified ones."""
        pairs = scratch.keep(pairs.select(F.greatest("doc_id", "near_id").alias("doc_id"), F.least("doc_id", "near_id").alias("near_id")).distinct(), f"{name}-pairs")
        both = pairs.join(text.withColumnsRenamed({"id": "doc_id", "text": "a"}), "doc_id").join(text.withColumnsRenamed({"id": "near_id", "text": "c"}), "near_id")
        found = both.select("doc_id", "near_id", "a", "c").mapInArrow(verify, "doc_id long, near_id long, jaccard double").where(F.col("jaccard") >= threshold)
        return pairs, scratch.keep(found, f"{name}-links")

    leaders = rows.groupBy("b", "v").agg(F.min("doc_id").alias("near_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    tried, links = passed(rows.join(leaders.hint("merge"), ["b", "v"]).where("doc_id <> near_id"), "first")
    for name in ("second", "rest"):
        labels = components(links.select(F.col("doc_id").alias("a"), F.col("near_id").alias("b")), scratch, f"before-{name}")
        known = rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        mixed = known.groupBy("b", "v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("doc_id", "comp"), F.xxhash64("doc_id")).alias("lead")).where("lo < hi")
        if name == "second":
            others = mixed.select("b", "v", F.col("lead.doc_id").alias("near_id"), F.col("lead.comp").alias("near_comp"))
        else:
            known = known.join(mixed.select("b", "v"), ["b", "v"], "left_semi")
            others = known.select("b", "v", F.col("doc_id").alias("near_id"), F.col("comp").alias("near_comp"))
        pairs = known.join(others.hint("merge"), ["b", "v"]).where("comp <> near_comp" if name == "second" else "comp <> near_comp AND near_id < doc_id")
        pairs = pairs.select(F.greatest("doc_id", "near_id").alias("doc_id"), F.least("doc_id", "near_id").alias("near_id"))
        more, found = passed(pairs.join(tried, ["doc_id", "near_id"], "left_anti"), name)
        tried, links = tried.unionByName(more), links.unionByName(found)
    return links
