"""N-gram Jaccard self-join by adaptive multi-match prefixes, and the components of its links.

A document is its set of five-word shingles. Two sets of similarity t share at least ceil(t * n) shingles, so under any
one global order their first n - ceil(t * n) + l shingles share l. The order is by document frequency, then hash.
Every document picks its own l: it lengthens its prefix as long as the estimated cost of its candidates falls, and
a pair needs min(l, l') shared prefix shingles before its sets are compared.

1. Documents with equal sets become one class; its smallest id stands for it.
2. Blocks of documents send each of their shingles once, with its count, to the shingle's hash partition (some bytes a
   shingle, however many documents have it), and get the corpus frequencies back. A shingle of one document alone comes
   first in the order and matches nothing: a document with more than n - ceil(t * n) of those has no partner and is done.
   The step is done once more among the documents left.
3. Documents left meet the head of their group under a few min-hash keys; verified links contract large groups of near
   copies, without the pairs inside them.
4. The multi-match prefix join finds every remaining pair between different components, and verifies it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SENT, block_table, blocked, by_part, count_rows, sum_rows, sums_in_order, texts_of
from .components import components
from .scratch import Scratch, fresh_names, has_irregular_ids
from .shingles import WIDTH, mix64, shingle_sets

NEED = 75  # percent
BLOCK_SHINGLES = 1_500_000
PART_SHINGLES = 1_000_000
MOST_MATCHES = 12
VERIFY_COST = 60.0
KEYS = 3
BITMAP_WORDS = 8
BITMAP = [f"bits{k}_" for k in range(BITMAP_WORDS)]


def _summary(docs: DataFrame, width: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            n, k1, k2 = [], [], []
            for s in shingle_sets(texts, width):
                n.append(len(s))
                k1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                k2.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["doc_id", "n", "k1", "k2"])

    return docs.mapInArrow(each, "doc_id long, n long, k1 long, k2 long")


def _of_texts(width: int):
    return lambda texts: shingle_sets(texts, width)


def _of_tokens(packed: list[bytes]) -> Iterator[np.ndarray]:
    for raw in packed:
        yield np.sort(np.frombuffer(raw, "<u8"))


LEFT = "doc_id long, n long, tokens binary, dfs binary"


def _shared_shingles(rows: DataFrame, sets_of, known: DataFrame, total: int, need: int) -> DataFrame:
    """LEFT: the known documents (doc_id, n) that may have a partner, with the shingles others have too, in the global order.

    rows are (doc_id, x); sets_of turns a batch of x into sorted arrays of hashes. Blocks send their shingles' counts to the
    shingles' hash partitions, whose answers are joined to the blocks' documents.
    """
    blocks, parts = max(12, -(-total // BLOCK_SHINGLES)), max(12, -(-total // PART_SHINGLES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    held = blocked(rows, blocks, by_id=True)

    def counts(table: pa.Table) -> pa.Table:
        keys = [np.zeros(0, np.uint64), *sets_of(texts_of(table)[1])]
        return block_table(count_rows(table.column("block")[0].as_py(), by_part(np.concatenate(keys), parts), parts))

    def select(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids = answers.filter(pa.compute.is_valid(answers.column("doc_id")))
        n_of = dict(zip(ids.column("doc_id").to_pylist(), ids.column("shingles").to_pylist(), strict=True))
        ids, texts = texts_of(table)
        own, sets = ids.to_pylist(), list(sets_of(texts))
        keys = np.concatenate([np.zeros(0, np.uint64), *sets])
        _, place = np.unique(by_part(keys, parts), return_inverse=True)
        df = sums_in_order(answers.filter(pa.compute.is_valid(answers.column("packed"))), 0, parts)[place] if len(keys) else place
        out, at = [], 0
        for doc_id, s in zip(own, sets, strict=True):
            mine = df[at : at + len(s)]
            at += len(s)
            shared = mine > 1
            n = n_of.get(doc_id)
            if n is None or shared.sum() < max(1, -(-n * need // 100)):
                continue
            s, mine = s[shared], mine[shared]
            order = np.lexsort((mix64(s), mine))
            out.append((doc_id, n, s[order].tobytes(), mine[order].astype("<u4").tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "tokens": pa.array(cols[2], pa.binary()), "dfs": pa.array(cols[3], pa.binary())})

    sums = held.groupBy("block").applyInArrow(counts, SENT).groupBy("part").applyInArrow(sum_rows, SENT)
    none = F.lit(None)
    asked = known.select(block("doc_id").alias("block"), F.lit(-1).cast("long").alias("part"), none.cast("long").alias("n"), none.cast("binary").alias("packed"), "doc_id", F.col("n").alias("shingles"))
    answers = sums.withColumns({"doc_id": none.cast("long"), "shingles": none.cast("long")}).union(asked)
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(select, LEFT)


def _stars(left: DataFrame, labels: DataFrame | None, keys: range, need: int, scratch: Scratch, name: str) -> DataFrame:
    """Candidates (a, b): each document with the head of its group under each min-hash key, if their components differ.

    The head is the document with the least share of shingles that are rare beside its commonest: of near copies, the
    nearest to the original.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, rank, many, shared = [], [], [], [], []
            for doc_id, n, raw, raw_df in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tokens, df = np.frombuffer(raw, "<u8"), np.frombuffer(raw_df, "<u4")
                rare = n - int((df * 4 >= df.max()).sum())
                for k in keys:
                    ids.append(doc_id)
                    out.append(int(mix64(tokens ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)).min().view(np.int64)))
                    rank.append(rare * 1000 // n)
                    many.append(n)
                    shared.append(len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, out, rank, many, shared)], ["doc_id", "key", "own", "n", "shared"])

    keyed = scratch.keep(left.select("doc_id", "n", "tokens", "dfs").mapInArrow(each, "doc_id long, key long, own long, n long, shared long"), name)
    if labels is not None:
        keyed = keyed.join(labels.select(F.col("node").alias("doc_id"), "comp"), "doc_id", "left")
    else:
        keyed = keyed.withColumn("comp", F.lit(None).cast("long"))
    keyed = keyed.withColumn("comp", F.coalesce("comp", "doc_id"))
    heads = keyed.groupBy("key").agg(F.min(F.struct("own", "doc_id", "n", "shared", "comp")).alias("h"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "h")
    heads = scratch.keep(heads, f"{name}-heads")
    met = keyed.join(heads, "key").where("h.comp <> comp").select(F.col("h.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("h.n").alias("n1"), "n", F.least("h.shared", "shared").alias("shared"))
    return met.where(_possible(F.col("n1"), F.col("n"), F.col("shared"), need)).select("a", "b").distinct()


def _possible(n1, n2, shared, need: int):
    """Sets of n1 and n2 shingles can only be near if as many as their overlap needs aren't a document's own."""
    return (shared * (100 + need) >= (n1 + n2) * need) & (n1 * 100 >= n2 * need) & (n2 * 100 >= n1 * need)


def _verified(pairs: DataFrame, left: DataFrame, need: int) -> DataFrame:
    """The pairs (a, b) that link: need percent of the union of their sets is shared."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ta, tb = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for i in range(len(a)):
                x, y = np.sort(np.frombuffer(ta[i], "<u8")), np.sort(np.frombuffer(tb[i], "<u8"))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= need * (na[i] + nb[i] - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    one = left.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = left.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ta", "tb")
    return both.mapInArrow(each, "a long, b long")


def _prefixes(left: DataFrame, need: int, most: int) -> DataFrame:
    """(token, doc_id, n, matches, place, shared): each document's adaptive prefix, with places in the global order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[] for _ in range(6 + BITMAP_WORDS)]
            for doc_id, n, raw, raw_df in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tokens, df = np.frombuffer(raw, "<i8"), np.frombuffer(raw_df, "<u4").astype(np.float64) - 1
                alone = n - len(tokens)
                required = -(-n * need // 100)
                cost = np.append(0.0, np.cumsum(df))
                best, best_cost, base = 1, None, n - required - alone
                for l in range(1, min(most, required) + 1):  # noqa: E741
                    scan = cost[min(len(tokens), base + l)]
                    total = scan + VERIFY_COST * scan / l
                    if best_cost is None or total < best_cost:
                        best, best_cost = l, total
                size = min(len(tokens), base + best)
                cols[0].append(tokens[:size])
                cols[1].append(np.full(size, doc_id, np.int64))
                cols[2].append(np.full(size, n, np.int64))
                cols[3].append(np.full(size, best, np.int32))
                cols[5].append(np.full(size, len(tokens), np.int64))
                bits = np.zeros(64 * BITMAP_WORDS, np.uint8)
                bits[(mix64(tokens.view(np.uint64)) % np.uint64(len(bits))).astype(np.int64)] = 1
                for k, word in enumerate(np.packbits(bits, bitorder="little").view("<i8")):
                    cols[6 + k].append(np.full(size, word, np.int64))
                cols[4].append(alone + np.arange(size, dtype=np.int64))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["token", "doc_id", "n", "matches", "place", "shared", *BITMAP])

    return left.select("doc_id", "n", "tokens", "dfs").mapInArrow(each, "token long, doc_id long, n long, matches int, place long, shared long, " + ", ".join(f"{b} long" for b in BITMAP))


def _candidates(prefixes: DataFrame, labels: DataFrame, need: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share as many prefix shingles as the shorter demand asks."""
    rows = prefixes.join(labels.select(F.col("node").alias("doc_id"), "comp"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    mixed = scratch.keep(mixed, "mixed")
    rows = rows.join(mixed, "token", "left_semi")
    one = rows.select("token", *(F.col(c).alias(f"{c}1") for c in ("doc_id", "n", "matches", "place", "comp", "shared", *BITMAP)))
    two = rows.select("token", *(F.col(c).alias(f"{c}2") for c in ("doc_id", "n", "matches", "place", "comp", "shared", *BITMAP)))
    few = F.least("matches1", "matches2")
    # The least l whose prefix a place belongs to, and the most shingles two sets share if they share one at these places.
    level = [F.greatest(F.lit(1), F.col(f"place{k}") - F.col(f"n{k}") + F.ceil(F.col(f"n{k}") * need / 100) + 1) for k in (1, 2)]
    before = F.least(*(F.col(f"place{k}") - F.col(f"n{k}") + F.col(f"shared{k}") for k in (1, 2)))
    after = F.least(*(F.col(f"n{k}") - F.col(f"place{k}") for k in (1, 2)))
    enough = (before + after) * (100 + need) >= (F.col("n1") + F.col("n2")) * need
    # A bit that one set has and the other lacks is a shingle, at least, that they don't share.
    lacks = [sum((F.bit_count(F.col(f"{b}{x}").bitwiseAND(F.bitwise_not(F.col(f"{b}{y}")))) for b in BITMAP), F.lit(0)) for x, y in ((1, 2), (2, 1))]
    enough = enough & (F.least(F.col("shared1") - lacks[0], F.col("shared2") - lacks[1]) * (100 + need) >= (F.col("n1") + F.col("n2")) * need)
    on = (F.col("doc_id1") < F.col("doc_id2")) & (F.col("comp1") != F.col("comp2")) & _possible(F.col("n1"), F.col("n2"), F.least("shared1", "shared2"), need) & enough & (F.greatest(*level) <= few)
    hits = one.join(two, "token").where(on)
    met = hits.groupBy(F.col("doc_id1").alias("a"), F.col("doc_id2").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.first(few).alias("few"))
    return met.where("shared >= few").select("a", "b")


def near_components(docs: DataFrame, need: int = NEED, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links).

    A document without words or text has an empty set and links with nothing. Repeated rows link with one another. Null
    and repeated ids are allowed: rows are then numbered for the join, and component_id is the smallest id that isn't
    null. An empty table gives an empty result. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    irregular = has_irregular_ids(rows, "doc_id")
    if irregular:
        numbered = scratch.keep(rows.withColumn("uid", F.monotonically_increasing_id()), "numbered")
        own = numbered.select("uid", F.col("doc_id").alias("id"))
        rows = numbered.select(F.col("uid").alias("doc_id"), "text")
    seen = scratch.keep(_summary(rows, width), "seen")
    # Written before the join, so that it is a join of two shuffles: then AQE splits the partition of a hot class.
    classes = scratch.keep(seen.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    members = scratch.keep(seen.join(classes, ["k1", "k2", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    scratch.drop("seen", "classes")
    total = members.agg(F.sum("n")).first()[0] or 0
    reps = members.where("doc_id = rep AND n > 0").select("doc_id", "n")
    some = scratch.keep(_shared_shingles(rows, _of_texts(width), reps, total, need), "some")
    # Once more among the documents left, without copies: a shingle that only copies shared is a document's own now.
    total = some.agg(F.sum("n")).first()[0] or 0
    left = scratch.keep(_shared_shingles(some.select("doc_id", "tokens"), _of_tokens, some.select("doc_id", "n"), total, need), "left")
    scratch.drop("some")
    first = scratch.keep(_verified(_stars(left, None, range(KEYS), need, scratch, "keys1"), left, need), "first")
    labels = components(first, scratch, "contract1")
    more = scratch.keep(_verified(_stars(left, labels, range(KEYS, 3 * KEYS), need, scratch, "keys2"), left, need), "more")
    first = first.unionByName(more)
    labels = components(first, scratch, "contract2")
    prefixes = scratch.keep(_prefixes(left, need, MOST_MATCHES), "prefixes")
    pairs = scratch.keep(_candidates(prefixes, labels, need, scratch), "pairs")
    second = scratch.keep(_verified(pairs, left, need), "second")
    whole = components(first.unionByName(second), scratch, "whole")
    scratch.drop("keys1", "keys2", "prefixes", "pairs", "left")
    out = members.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    if not irregular:
        return out
    named = out.join(own.withColumnRenamed("uid", "doc_id"), "doc_id")
    least = named.groupBy("component_id").agg(F.min("id").alias("least"))
    return named.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def drop_near(docs: DataFrame, need: int = NEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each component: the row with its smallest id, or any one row where ids repeat or are null."""
    cols = docs.columns
    row, kept = fresh_names(docs, "row", "kept")
    if has_irregular_ids(docs, id_col):
        docs = Scratch(docs.sparkSession, "near").keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        id_col = row
    found = near_components(docs, need, WIDTH, id_col, text_col)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(kept))
    return docs.join(keep, F.col(id_col).cast("long") == F.col(kept), "left_semi").select(*cols)
