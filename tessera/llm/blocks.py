"""Packed columns for shuffles: numbers as byte planes, texts as one run of bytes, both under zstd."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: zero bytes lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(raw: memoryview, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(dtype).reshape(n)


def pack(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(map(planes, columns)), codec="zstd", asbytes=True)


def unpack(packed: bytes, *columns: tuple[str, int]) -> list[np.ndarray]:
    """columns: (dtype, length) of each, as packed."""
    sizes = [np.dtype(t).itemsize * n for t, n in columns]
    raw = memoryview(pa.decompress(packed, decompressed_size=sum(sizes), codec="zstd", asbytes=True))
    out, at = [], 0
    for (dtype, n), size in zip(columns, sizes, strict=True):
        out.append(from_planes(raw[at : at + size], dtype, n))
        at += size
    return out


#: The texts of a block that came in one Arrow batch: n of them, with their numbers (ids, whether there is one, bytes).
TEXTS = "block long, n long, size long, numbers binary, texts binary"


def blocked(rows: DataFrame, blocks: int, by_id: bool = False) -> DataFrame:
    """TEXTS of rows (id long, text or bytes), dealt by hash of both, or of the id, over blocks; a null text is an empty one.

    Texts of a batch and block are compressed together, which takes a third of a shuffle of rows, and no string is built.
    """
    id_, text = rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            batch = batch.take(pa.array(order))
            block = block[order]
            texts = pa.compute.fill_null(batch.column(2), b"")
            wide = pa.types.is_large_binary(texts.type)
            at = np.frombuffer(texts.buffers()[1], "<i8" if wide else "<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = memoryview(texts.buffers()[2] or b"")
            ids, known = pa.compute.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False), pa.compute.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.diff(block, prepend=block[0] - 1)), len(block))
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                numbers = pack(ids[a:b].astype("<i8"), known[a:b].astype("u1"), np.diff(at[a : b + 1]).astype("<i8"))
                out.append((int(block[a]), int(b - a), int(at[b] - at[a]), numbers, pa.compress(data[at[a] : at[b]], codec="zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], [f.split()[0] for f in TEXTS.split(", ")])

    dealt = rows.select(F.pmod(F.xxhash64(id_) if by_id else F.xxhash64(id_, text), F.lit(blocks)).alias("block"), F.col(id_).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return dealt.mapInArrow(each, TEXTS)


def texts_of(table: pa.Table) -> tuple[pa.Array, list[bytes]]:
    """(ids, texts) of TEXTS."""
    ids, known, texts = [np.zeros(0, np.int64)], [np.zeros(0, bool)], []
    for n, size, numbers, packed in zip(*(table.column(c).to_pylist() for c in ("n", "size", "numbers", "texts")), strict=True):
        own, valid, sizes = unpack(numbers, ("<i8", n), ("u1", n), ("<i8", n))
        raw = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        ends = np.cumsum(sizes)
        texts += [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        ids.append(own)
        known.append(valid > 0)
    return pa.array(np.concatenate(ids), pa.int64(), mask=~np.concatenate(known)), texts


#: What a block of documents sends to a hash partition of keys, and what comes back: n numbers in the order of its keys.
SENT = "block long, part long, n long, packed binary"
LOW_BITS = np.uint64(40)


def block_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({name: pa.array(c, t) for name, c, t in zip(("block", "part", "n", "packed"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)})


def by_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """64-bit keys as partition and low bits: in sorted order each partition's keys lie together."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (part << LOW_BITS) | (keys & ((np.uint64(1) << LOW_BITS) - np.uint64(1)))


def count_rows(block: int, keys: np.ndarray, parts: int, base: int = 0, whole: bool = False) -> list[tuple]:
    """Rows of SENT with the block's counts of its keys, a row per partition.

    Keys are made by by_part, or whole: all 64 bits. Partitions rise with whole keys too, so their sorted order is the same.
    """
    every, count = np.unique(keys, return_counts=True)
    part = ((every >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32) if whole else every >> LOW_BITS
    edges = np.searchsorted(part.astype(np.int64), np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(edges)):
        mine = slice(edges[p], edges[p + 1])
        start = np.uint64(0) if whole else np.uint64(p) << LOW_BITS
        rows.append((block, base + int(p), int(edges[p + 1] - edges[p]), pack(np.diff(every[mine], prepend=start), count[mine].astype("<u4"))))
    return rows


def sum_rows(table: pa.Table) -> pa.Table:
    """The count table of one partition, joined to what the blocks sent: the sums, in the order of each block's keys."""
    blocks, part, sizes, packs = (table.column(c).to_pylist() for c in ("block", "part", "n", "packed"))
    keys, counts = [], []
    for n, packed in zip(sizes, packs, strict=True):
        steps, count = unpack(packed, ("<u8", n), ("<u4", n))
        keys.append(np.cumsum(steps, dtype=np.uint64))
        counts.append(count)
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype("<u8")[place]
    edges = np.append(0, np.cumsum(sizes))
    return block_table([(blocks[i], part[i], sizes[i], pack(total[edges[i] : edges[i + 1]])) for i in range(len(blocks))])


def sums_in_order(table: pa.Table, first: int, last: int) -> np.ndarray:
    """A block's answers from partitions first to last - 1, in the order of its sorted keys."""
    rows = sorted(r for r in zip(*(table.column(c).to_pylist() for c in ("part", "n", "packed")), strict=True) if first <= r[0] < last)
    return np.concatenate([unpack(p, ("<u8", n))[0] for _, n, p in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
