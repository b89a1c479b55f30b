"""Stupid-backoff scores of documents by a trigram model counted over the whole corpus.

Words are runs of anything but ASCII white space, A-Z lower-cased. The word w after u v scores
    c(u v w) / c(u v)  if the trigram also stands in another document, else
    0.4 * c(v w) / c(v)  if the bigram does, else
    0.16 * c(w) / N    if the word does, else 0.16 / N;
the second word of a text starts at the bigram, the first at the word. All counts leave the scored document out, so that
no text vouches for itself: c is the corpus count less the document's own, and so is N, the number of words.

The corpus falls into blocks of documents of about BLOCK_CHARS characters. A block counts its n-grams and sends each
one once, with its count, to the hash partition of the n-gram: the count tables, partitioned by hash. A partition
joins what the blocks sent, and answers each block with the sums. A block then joins them to its exploded
n-grams and sums the log scores per document.

Scale: an n-gram costs a block a few bytes, however often it occurs, so a frequent one is a row per block and no
key is hot. Texts are shuffled once, into blocks, for both uses. No count passes the driver but the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SENT, block_table, blocked, count_rows, sum_rows, sums_in_order, texts_of
from .shingles import SLICE_BYTES, sequence_hashes, slices, word_hashes

ORDER = 3
BACKOFF = 0.4
BLOCK_CHARS = 10_000_000
PART_KEYS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


class Block:
    """n-grams of a block's texts: words of all texts, and for each order the places where one starts."""

    def __init__(self, texts: list[bytes]):
        words, first = [], [np.zeros(1, np.int64)]
        for a, b in slices(texts, SLICE_BYTES):
            own, at = word_hashes(texts[a:b])
            words.append(own)
            first.append(first[-1][-1] + at[1:])
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.first = np.concatenate(first)
        self.lengths = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int64), self.lengths)

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the first word, keys): n-grams within a text."""
        n = len(self.words) - order + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        places = np.flatnonzero(self.doc[:n] == self.doc[order - 1 :])
        return places, sequence_hashes(self.words, order)[places]


SCORES = "doc_id long, n_words long, n_trigram long, n_bigram long, log_score double, mean_log_score double"


def _counts(docs: DataFrame, parts: int) -> DataFrame:
    def each(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        grams = Block(texts_of(table)[1])
        return block_table([row for k in range(ORDER) for row in count_rows(block, grams.grams(k + 1)[1], parts, k * parts, whole=True)])

    return docs.groupBy("block").applyInArrow(each, SENT)


def _scored(docs: DataFrame, sums: DataFrame, parts: int, n_words: int) -> DataFrame:
    def each(docs_table: pa.Table, sums_table: pa.Table) -> pa.Table:
        ids, texts = texts_of(docs_table)
        grams, n_texts = Block(texts), len(texts)
        del texts
        others = []  # for each order, by place: how often the n-gram that starts there stands in other documents
        for order in range(1, ORDER + 1):
            places, keys = grams.grams(order)
            every, at = np.unique(keys, return_inverse=True)
            total = sums_in_order(sums_table, (order - 1) * parts, order * parts)
            _, own, times = np.unique(grams.doc[places] * max(1, len(every)) + at, return_inverse=True, return_counts=True)
            left = np.zeros(len(grams.words), np.int64)
            left[places] = total[at] - times[own]
            others.append(left)
        one, two, three = (o.astype(np.float64) for o in others)
        n = len(grams.words)
        here = np.arange(n) - grams.first[grams.doc]  # place in the text
        rest = np.maximum(n_words - grams.lengths[grams.doc], 1).astype(np.float64)
        before = lambda x, k: np.concatenate([np.zeros(min(k, n)), x[: n - k]]) if n > k else np.zeros(n)
        tri, bi = np.where(here >= 2, before(three, 2), 0), np.where(here >= 1, before(two, 1), 0)
        unigram = np.maximum(one, 1) / rest * BACKOFF ** np.minimum(here, 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            bigram = bi / before(one, 1) * BACKOFF ** (here >= 2)
            trigram = tri / before(two, 2)
        log = np.log(np.where(tri > 0, trigram, np.where(bi > 0, bigram, unigram)))
        add = lambda x: np.bincount(grams.doc, weights=x, minlength=n_texts).astype(np.float64)
        score = add(log)
        cols = [grams.lengths, add(tri > 0).astype(np.int64), add((tri == 0) & (bi > 0)).astype(np.int64), score]
        mean = pa.array(score / np.maximum(grams.lengths, 1), mask=grams.lengths == 0)
        return pa.table([ids, *(pa.array(c) for c in cols), mean], names=[f.split()[0] for f in SCORES.split(", ")])

    return docs.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(each, SCORES)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, part_keys: int = PART_KEYS) -> DataFrame:
    """One row per document: SCORES. log_score sums natural logs; mean_log_score is per word.

    A text without words, or a null one, has n_words 0, log_score 0 and a null mean. Repeated rows count as further
    documents. An empty table gives an empty result; a null doc_id stays null; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text")), F.sum(F.regexp_count("text", F.lit(WORD)))).first()
    chars, n_words = total[0] or 0, total[1] or 0
    blocks = max(12, -(-chars // block_chars))
    parts = max(12, -(-n_words // part_keys))
    rows = blocked(rows, blocks)
    return _scored(rows, _counts(rows, parts).groupBy("part").applyInArrow(sum_rows, SENT), parts, n_words)
