from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.packing import PLAIN, Encoder, pack, plan


def check(found, rows, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % capacity or capacity
        edges = [0, *range(head, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_edge_rows(edge, edge_rows):
    n = check(pack(edge).collect(), edge_rows, 2048)
    total = sum(r["length"] for r in pack(edge).collect())
    assert n <= -(-total // 2048) + 1


def test_small_capacity_and_repeated_rows(irregular, empty):
    df, rows = irregular
    check(pack(df, capacity=37).collect(), rows, 37)
    assert pack(empty).count() == 0


def test_special_token_text(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "漢字 ﬁ 😀   x")]
    check(pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, 2048)


def unpacked(bins):
    out = Counter()
    for lengths, times in bins:
        for n in lengths:
            out[n] += times
    return dict(out)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=20))
def test_plan_places_every_piece_once(histogram):
    bins = plan(histogram, 60)
    assert unpacked(bins) == histogram
    assert all(sum(lengths) <= 60 and times > 0 for lengths, times in bins)
    assert all(sum(3 * n > 60 for n in lengths) <= 2 for lengths, _ in bins)
    total = sum(n * c for n, c in histogram.items())
    assert sum(t for _, t in bins) <= 1.25 * total / 60 + 3 + sum(c for n, c in histogram.items() if 2 * n > 60)


def test_plan_is_near_the_bound():
    rng = random.Random(3)
    histogram = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    bins = plan(histogram)
    assert sum(t for _, t in bins) <= 1.01 * sum(n * c for n, c in histogram.items()) / 2048


def test_both_tokenizers_agree_on_plain_texts():
    """The fast form is used on these characters alone."""
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    every = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    tricky = [*" \n\t\r\x0b\x0c\x1c\x85\xa0'asé1².!ª"]
    for k in range(1500):
        text = "".join(rng.choice(tricky if k % 2 else every) for _ in range(rng.randint(0, 40)))
        assert PLAIN.fullmatch(text)
        assert encoder.fast.encode_to_numpy(text).tolist() == encoder.exact.encode(text, add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """The plan's rules for single pieces: gaps of the bins, in order."""
    large, gaps = sorted(n for n in lengths if 3 * n > capacity), []
    while large:
        top = large.pop()
        mates = [i for i, n in enumerate(large) if top + n <= capacity]
        gaps.append(capacity - top - (large.pop(mates[-1]) if mates else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [i for i, gap in enumerate(gaps) if gap >= n]
        if fits:
            at = min(fits, key=lambda i: gaps[i])
            gaps[at] -= n
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 12), max_size=25))
def test_plan_is_that_of_single_pieces(histogram):
    lengths = [n for n, c in histogram.items() for _ in range(c)]
    assert sorted(60 - sum(bin_) for bin_, times in plan(histogram, 60) for _ in range(times)) == one_by_one(lengths, 60)


def test_many_buckets_and_copies_of_one_document(spark):
    rows = [(1, "a b c " * 40)] * 300 + [(i, "d " * (i % 50)) for i in range(2, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for bucket_rows in (1, 1000):
        check(pack(df, capacity=130, bucket_rows=bucket_rows).collect(), rows, 130)
