"""Repeated byte strings removed exactly, by difference-cover suffix sorting of what can repeat at all.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the corpus. Strings are compared through
anchors: of the GRAM-byte substrings of a string, the one with the least hash. Equal strings have it at one place, so
both copies of a repeated string lie around an anchor that stands twice.

1. Each block of documents counts its anchors in hash partitions (a few bytes each), and learns which repeat.
2. Around each repeated anchor all strings of LENGTH with that anchor form a context of 2 * LENGTH - GRAM bytes. Contexts
   that are equal within a block go there and then, all but the first. Each other one goes on in two pieces: strings that
   start in one piece all have a core of bytes in common, and each piece goes to the hash partition of its core. Around an
   anchor that very many documents share there are 8 pieces, or a piece for each string, whose core is the string itself:
   then only equal strings meet, one of each block.
3. A partition drops pieces that are equal to an earlier one. Those left that share a core with another are sorted by
   their suffixes (suffixes.suffix_array: sampled triples, recursion on names, merge), and adjacent suffixes are compared
   over LENGTH bytes. All but the earliest of equal strings are repeats.
4. The blocks merge the repeats of their documents and cut them out.

Equality is always that of bytes: hashes only gather what is then compared.

Scale: texts are shuffled into blocks once, for all uses. A passage that many documents share costs a block one context a
place. No core has more rows than TIERS[1], however common a line is. Partitions sort in chunks of whole cores. No count or
list passes the driver.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SENT, block_table, blocked, by_part, count_rows, pack, sum_rows, sums_in_order, texts_of, unpack
from .scratch import Scratch, has_irregular_ids
from .shingles import SLICE_BYTES, mix64, slices
from .suffixes import suffix_array

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 10_000_000
PART_BYTES = 3_000_000
CHUNK_CONTEXTS = 2048
#: An anchor that stands more often than this in the corpus has its contexts cut into 8 pieces, or into single strings.
TIERS = (65_536, 262_144)
BEFORE, AFTER = 0xFF, 0xFE  # bytes that UTF-8 never has: beyond a document's start and end
_LETTER = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _slide(pick, x: np.ndarray, width: int) -> np.ndarray:
    """pick (a minimum or maximum) over every width consecutive numbers."""
    step = 1
    while step * 2 <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of the gram bytes (a power of two) from each place on."""
    h, step, power = _LETTER[data], 1, _BASE
    while step < gram:
        h = h[:-step] * np.uint64(power) + h[step:]
        power, step = power * power % (1 << 64), step * 2
    return mix64(h)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of every string of length within the documents [start, end) of data.

    Documents have length bytes at least. Where the least hash stands twice in a string, both are its anchors.
    """
    width = length - gram + 1
    h = _gram_hashes(data, gram)
    value = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    whole = np.zeros(len(data) + 1, np.int32)  # where a string of length starts that lies in one document
    np.add.at(whole, starts, 1)
    np.add.at(whole, ends - length + 1, -1)
    least = _slide(np.minimum, value, width)
    least[np.cumsum(whole[: len(least)]) == 0] = 0
    pad = np.zeros(width - 1, np.uint32)
    at = np.flatnonzero(_slide(np.maximum, np.concatenate([pad, least, pad]), width) == value)
    return at, h[at]


class Documents:
    """The texts of a block that have strings of length at all, in slices with a gap after each text."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        ids, self.texts = texts_of(table)
        self.ids = ids.to_numpy()
        self.length, self.gram = length, gram

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(data, document of each anchor in the block, its start and end, places, hashes) of each slice."""
        long = [i for i, t in enumerate(self.texts) if len(t) >= self.length]
        for a, b in slices([self.texts[i] for i in long], SLICE_BYTES):
            texts = [self.texts[i] for i in long[a:b]]
            data = np.frombuffer(b"\xff".join(texts) + b"\xff" * self.length, np.uint8)
            ends = np.cumsum([len(t) + 1 for t in texts]) - 1
            starts = np.append(0, ends[:-1] + 1)
            at, h = anchors(data, starts, ends, self.length, self.gram)
            mine = np.searchsorted(starts, at, side="right") - 1
            yield data, np.asarray(long[a:b])[mine], starts[mine], ends[mine], at, h

    def contexts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        side = self.length - self.gram
        place = at[:, None] + np.arange(-side, self.length)
        out = data[np.clip(place, 0, len(data) - 1)]
        out[place < start[:, None]] = BEFORE
        out[place >= end[:, None]] = AFTER
        return out


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    width = -(-rows.shape[1] // 8) * 8
    if width != rows.shape[1]:
        rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    words = np.ascontiguousarray(rows).view("<u8")
    out = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        out = mix64(out ^ words[:, k]) + np.uint64(k + 1)
    return out


def _bounds(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 column of each context that lies in its document."""
    return (contexts == BEFORE).sum(axis=1), contexts.shape[1] - (contexts == AFTER).sum(axis=1)


def _first_of_equal(rows: np.ndarray, uid: np.ndarray, at: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Whether a row is the earliest of those with its bytes. Rows are gathered by hash, and compared byte by byte.

    A row that shares a hash with an earlier one and differs in bytes counts as a first one.
    """
    h = _row_hash(rows) if hashes is None else hashes
    order = np.lexsort((at, uid, h))
    heads = np.diff(h[order], prepend=~h[order[:1]]) != 0
    out = np.zeros(len(h), bool)
    out[order[heads]] = True
    head = order[np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))]
    for a in range(0, len(order), 1 << 16):  # some at a time
        mine = order[a : a + (1 << 16)]
        out[mine[(rows[mine] != rows[head[a : a + (1 << 16)]]).any(axis=1)]] = True
    return out


def _sorted_repeats(cols: np.ndarray, uid: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """For each row and column where a string of length starts: whether an equal one starts earlier in another row or place.

    start is the document's byte at each row's first column.
    """
    m, width = cols.shape
    lo, hi = _bounds(cols)
    text = np.zeros((m, width + 1), np.int32)
    text[:, :width] = cols
    text += 1  # the gap between contexts is 1, bytes start at 2
    text[:, :width] += 1
    text[:, width] = 1
    order = suffix_array(text.ravel())
    row, col = order // (width + 1), order % (width + 1)
    del text
    valid = (col >= lo[row]) & (col + length <= hi[row])
    order, row, col = order[valid], row[valid], col[valid]
    out = np.zeros((m, width - length + 1), bool)
    if not len(order):
        return out
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([cols, np.zeros((m, 1), np.uint8)], axis=1).ravel(), length)
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 1 << 16):  # adjacent prefixes, some at a time
        b = min(a + (1 << 16), len(order))
        same[a:b] = (view[order[a:b]] == view[order[a - 1 : b - 1]]).all(axis=1)
    run = np.cumsum(~same) - 1
    u, p = uid[row], start[row] + col
    by = np.lexsort((p, u, run))
    heads = by[np.diff(run[by], prepend=-1) != 0]
    later = (u != u[heads][run]) | (p != p[heads][run])
    out[row[later], col[later]] = True
    return out


def _pieces(length: int, gram: int, parts: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(tier, first and last column where its strings start, first partition, partitions) of each piece; the partitions of all.

    The strings of a piece share the core between; the more pieces a tier has, the longer it is. In the last tier a piece is
    one start, and its string the core. The pieces of a tier share out as many partitions as there are parts.
    """
    starts = length - gram + 1
    out, at = [], 0
    for tier, n in enumerate((2, min(8, starts), starts)):
        edges = [round(k * starts / n) for k in range(n + 1)]
        own = parts if tier == 0 else -(-parts // n)
        for a, b in zip(edges, edges[1:], strict=False):
            out.append((tier, a, b - 1, at, own))
            at += own
    return out, at


def _repeats(cols: np.ndarray, uid: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """(rows, width - length + 1) of distinct pieces of contexts: where strings start that also start earlier.

    Only rows that agree on the core, the bytes that all their strings have, can have a string in common.
    """
    last = cols.shape[1] - length
    out = np.zeros((len(cols), last + 1), bool)
    h = _row_hash(cols[:, last:length])
    order = np.argsort(h, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0), len(order))
    groups = [order[edges[i] : edges[i + 1]] for i in np.flatnonzero(np.diff(edges) > 1)]
    chunk: list[np.ndarray] = []
    held = 0
    for k, rows in enumerate(groups):
        chunk.append(rows)
        held += len(rows)
        if held >= CHUNK_CONTEXTS or k == len(groups) - 1:
            mine = np.concatenate(chunk)
            out[mine] = _sorted_repeats(cols[mine], uid[mine], start[mine], length)
            chunk, held = [], 0
    return out


def _spans(uid: np.ndarray, base: np.ndarray, covered: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, start, end) of the bytes that the marked strings cover; base is the document's byte at column 0."""
    edge = np.diff(covered.astype(np.int8), axis=1, prepend=0, append=0)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return uid[row], base[row] + first, base[row] + last - 1 + length


def _parts_sent(docs: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    def each(table: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64), *(s[-1] for s in Documents(table, length, gram).slices())]
        return block_table(count_rows(table.column("block")[0].as_py(), by_part(np.concatenate(found), parts), parts))

    return docs.groupBy("block").applyInArrow(each, SENT)


CONTEXTS = "part long, block long, n long, packed binary, contexts binary"


def _pack_spans(part: int, block: int, uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
    return part, block, len(uid), pack(uid.astype("<i8"), start.astype("<i8"), end.astype("<i8")), None


def _context_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({name: pa.array(c, t) for name, c, t in zip(("part", "block", "n", "packed", "contexts"), cols, kinds, strict=True)})


def _contexts(docs: DataFrame, sums: DataFrame, parts: int, length: int, gram: int, tiers: tuple[int, int]) -> DataFrame:
    """Pieces of the contexts of repeated anchors, for their cores' partitions; and spans known to go, for partitions beyond.

    How often an anchor stands in the corpus decides the tier, and so how many pieces there are: all blocks agree on it.
    """
    pieces, beyond = _pieces(length, gram, parts)

    def each(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _context_table([])
        block = table.column("block")[0].as_py()
        docs_ = Documents(table, length, gram)
        found = list(docs_.slices())
        if not found:
            return _context_table([])
        keys = by_part(np.concatenate([s[-1] for s in found]), parts)
        _, place = np.unique(keys, return_inverse=True)
        total = sums_in_order(answers, 0, parts)[place]
        repeated = total > 1
        at0, kept = 0, []
        for data, doc, start, end, at, _ in found:
            own = repeated[at0 : at0 + len(at)]
            at0 += len(at)
            tier = np.searchsorted(tiers, total[at0 - len(at) : at0][own])
            kept.append((docs_.ids[doc[own]], at[own] - start[own], tier, docs_.contexts(data, start[own], end[own], at[own])))
        del found
        uid, at, tier, ctx = (np.concatenate(c) for c in zip(*kept, strict=True))
        del kept
        lo, hi = _bounds(ctx)
        some = hi - lo >= length
        uid, at, tier, ctx, lo, hi = (x[some] for x in (uid, at, tier, ctx, lo, hi))
        if not len(uid):
            return _context_table([])
        kept_here = _first_of_equal(ctx, uid, at)
        base, gone = at - (length - gram), ~kept_here
        rows = [_pack_spans(beyond + block, block, uid[gone], (base + lo)[gone], (base + hi)[gone])] if gone.any() else []
        for t, first, last, part0, n_parts in pieces:
            mine = np.flatnonzero(kept_here & (tier == t) & (np.maximum(lo, first) <= np.minimum(hi - length, last)))
            if not len(mine):
                continue
            if t:  # of a hot anchor's contexts many agree on a piece: one of them goes on
                fresh = _first_of_equal(ctx[mine, first : last + length], uid[mine], at[mine])
                gone = mine[~fresh]
                if len(gone):
                    rows.append(_pack_spans(beyond + block, block, uid[gone], (base + np.maximum(lo, first))[gone], (base + np.minimum(hi, last + length))[gone]))
                mine = mine[fresh]
            core = _row_hash(ctx[mine, last : first + length])
            key = (((core >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            mine, edges = mine[order], np.searchsorted(key[order], np.arange(n_parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                own = mine[edges[p] : edges[p + 1]]
                raw = pa.compress(ctx[own, first : last + length].tobytes(), codec="zstd", asbytes=True)
                rows.append((part0 + int(p), block, len(own), pack(uid[own].astype("<i8"), (base[own] + first).astype("<i8")), raw))
        return _context_table(rows)

    return docs.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(each, CONTEXTS)


def _resolved(contexts: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """Spans to remove, by block."""
    pieces, beyond = _pieces(length, gram, parts)
    starts = [p[3] for p in pieces]

    def each(table: pa.Table) -> pa.Table:
        part, block, sizes, packs, raw = (table.column(c).to_pylist() for c in ("part", "block", "n", "packed", "contexts"))
        if part[0] >= beyond:
            return table
        _, first, last, _, _ = pieces[bisect.bisect_right(starts, part[0]) - 1]
        width = last - first + length
        read = [unpack(p, ("<i8", n), ("<i8", n)) for n, p in zip(sizes, packs, strict=True)]
        uid, start = (np.concatenate(c) for c in zip(*read, strict=True))
        cols = np.concatenate([np.frombuffer(pa.decompress(r, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(n, width) for n, r in zip(sizes, raw, strict=True)])
        owner = np.repeat(np.asarray(block), sizes)
        fresh = _first_of_equal(cols, uid, start)
        lo, hi = _bounds(cols)
        spans = [(owner[~fresh], uid[~fresh], (start + lo)[~fresh], (start + hi)[~fresh])]
        covered = _repeats(cols[fresh], uid[fresh], start[fresh], length)
        row_owner = np.repeat(owner[fresh], (np.diff(covered.astype(np.int8), axis=1, prepend=0) == 1).sum(axis=1))
        spans.append((row_owner, *_spans(uid[fresh], start[fresh], covered, length)))
        owner, uid, start, end = (np.concatenate(c) for c in zip(*spans, strict=True))
        order = np.argsort(owner, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(owner[order], prepend=-1)), len(order))
        rows = []
        for a, b in zip(edges, edges[1:], strict=False):
            mine = order[a:b]
            rows.append(_pack_spans(part[0], int(owner[mine[0]]), uid[mine], start[mine], end[mine]))
        return _context_table(rows)

    return contexts.groupBy("part").applyInArrow(each, CONTEXTS)


RESULT = "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(docs: DataFrame, spans: DataFrame, length: int, gram: int, with_text: bool) -> DataFrame:
    def each(table: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts = texts_of(table)
        ids = ids.to_numpy()
        size = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(size + 1) - size - 1  # a gap after each text keeps runs apart
        mark = np.zeros(int((size + 1).sum()) + 1, np.int32)
        order = np.argsort(ids)
        for n, packed in zip(found.column("n").to_pylist(), found.column("packed").to_pylist(), strict=True):
            uid, a, b = unpack(packed, ("<i8", n), ("<i8", n), ("<i8", n))
            at = start[order[np.searchsorted(ids[order], uid)]]
            np.add.at(mark, at + a, 1)
            np.add.at(mark, at + b, -1)
        gone = np.cumsum(mark)[:-1] > 0
        begins = np.diff(gone.astype(np.int8), prepend=0) == 1
        removed = np.add.reduceat(gone, start).astype(np.int64) if len(start) else size
        runs = np.add.reduceat(begins, start).astype(np.int64) if len(start) else size
        kept, digest = [], []
        for i, text in enumerate(texts):
            if removed[i]:
                text = np.frombuffer(text, np.uint8)[~gone[start[i] : start[i] + size[i]]].tobytes()
            digest.append(hashlib.sha256(text).hexdigest())
            kept.append(text if with_text else None)
        return pa.table([pa.array(ids), pa.array(size), pa.array(removed), pa.array(runs), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=[f.split()[0] for f in RESULT.split(", ")])

    return docs.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(each, RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, tiers: tuple[int, int] = TIERS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; and kept, the bytes left, if with_text.

    Earlier means a smaller id, or the same document and an earlier start. A null text counts as empty. Null ids come first;
    rows that share an id are documents of their own, ordered by text, and equal rows in any order. An empty table gives
    an empty result. Other columns aren't read. Bytes left need not be UTF-8.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    irregular = has_irregular_ids(rows, "doc_id")
    if irregular:
        ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        rows = scratch.keep(ordered.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    else:
        rows = rows.withColumn("uid", F.col("doc_id"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(12, -(-total // block_bytes)), max(12, -(-total // part_bytes))
    held = blocked(rows.select("uid", "text"), blocks)
    sums = _parts_sent(held, parts, length, gram).groupBy("part").applyInArrow(sum_rows, SENT)
    spans = _resolved(_contexts(held, sums, parts, length, gram, tiers), parts, length, gram)
    out = _cut(held, spans, length, gram, with_text)
    if irregular:
        out = out.join(rows.select("uid", "doc_id"), "uid")
    else:
        out = out.withColumnRenamed("uid", "doc_id")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
