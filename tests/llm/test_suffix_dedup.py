from __future__ import annotations

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import by_id

from tessera.llm.suffix_dedup import _first_of_equal, remove_repeats
from tessera.llm.suffixes import suffix_array


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80))
def test_suffix_array(numbers):
    assert suffix_array(np.array(numbers, np.int64)).tolist() == sorted(range(len(numbers)), key=lambda i: numbers[i:])


def brute(rows, length=100):
    """rows in order: (n_bytes, n_removed, n_spans, kept bytes) of each."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if x in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(x)
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def check(df, rows, **sizes):
    found = by_id(remove_repeats(df, with_text=True, **sizes).collect())
    rows = sorted(rows)
    assert len(found) == len(rows)
    for r, want in zip(rows, brute([r[1] for r in rows], sizes.get("length", 100)), strict=True):
        mine = found[r[0]]
        assert (mine["n_bytes"], mine["n_removed"], mine["n_spans"], bytes(mine["kept"])) == want, r[0]
        assert mine["kept_sha256"] == hashlib.sha256(want[3]).hexdigest()


def test_edge_rows(edge, edge_rows):
    check(edge, edge_rows)


def test_many_overlaps(spark):
    """Texts of few letters, cut from one another, in many small blocks and partitions."""
    rng = random.Random(2)
    pool = ["".join(rng.choice("ab") for _ in range(400)), "ab" * 150, "a" * 260, "".join(rng.choice("abcdé ") for _ in range(900))]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            text += p[a : a + rng.randint(20, 220)]
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows, block_bytes=2000, part_bytes=1500)
    check(df, rows, length=40, gram=16)
    check(df, rows, block_bytes=2000, part_bytes=1500, tiers=(3, 10))
    check(df, rows, length=40, gram=16, block_bytes=900, tiers=(2, 5))


def test_a_line_that_all_share(spark):
    """Hot anchors: contexts of other neighbours around one line, in every tier."""
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    noise = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = [(i, noise(rng.randint(0, 90)) + line[: rng.choice((130, 130, 99, 101))] + noise(rng.randint(0, 90))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tiers in ((65_536, 262_144), (10, 1000), (5, 20)):
        check(df, rows, block_bytes=1500, part_bytes=2000, tiers=tiers)


def test_equal_hashes_of_other_bytes_stay_apart():
    rows = np.array([[1, 2], [1, 2], [3, 4], [1, 2], [3, 4]], np.uint8)
    first = _first_of_equal(rows, np.arange(5), np.zeros(5, np.int64), np.zeros(5, np.uint64))
    assert first.tolist() == [True, False, True, False, True]


def test_repeated_rows_and_null_ids(irregular, empty):
    df, rows = irregular
    found = remove_repeats(df).collect()
    assert len(found) == len(rows)
    # Of equal texts of 100 bytes and more, one document stays whole.
    assert sum(r["n_removed"] == r["n_bytes"] for r in found if r["doc_id"] == rows[3][0] and r["n_bytes"] >= 100) in (0, 2, 3)
    assert remove_repeats(empty).count() == 0
