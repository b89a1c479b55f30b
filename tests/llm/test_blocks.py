from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.blocks import block_table, blocked, by_part, count_rows, pack, sum_rows, sums_in_order, texts_of, unpack


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=50), st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packed_columns_come_back(a, b):
    x, y = np.array(a, "<u8"), np.array(b, "<u4")
    back = unpack(pack(x, y), ("<u8", len(x)), ("<u4", len(y)))
    assert (back[0] == x).all() and (back[1] == y).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=40), min_size=1, max_size=6), st.integers(1, 9))
def test_answers_are_the_sums_of_all_blocks(blocks, parts):
    spread = lambda ks: np.array(ks, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sent = [r for i, ks in enumerate(blocks) for r in count_rows(i, by_part(spread(ks), parts), parts)]
    answers = [sum_rows(block_table([r for r in sent if r[1] == p])) for p in sorted({r[1] for r in sent})]
    table = pa.concat_tables(answers) if answers else block_table([])
    total = Counter(k for ks in blocks for k in ks)
    for i, ks in enumerate(blocks):
        _, place = np.unique(by_part(spread(ks), parts), return_inverse=True)
        mine = sums_in_order(table.filter(pa.compute.equal(table.column("block"), i)), 0, parts)
        assert [int(mine[p]) for p in place] == [total[k] for k in ks]


def test_texts_of_blocks_come_back(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "é" * 50, "x" * 100_000, " a\n"] * 7)] + [(None, "no id"), (None, None)]
    sent = blocked(spark.createDataFrame(rows, "id long, text string").repartition(3), 4).toArrow()
    back = []
    for b in set(sent.column("block").to_pylist()):
        ids, texts = texts_of(sent.filter(pa.compute.equal(sent.column("block"), b)))
        back += zip(ids.to_pylist(), texts, strict=True)
    assert sorted(back, key=repr) == sorted(((i, (t or "").encode()) for i, t in rows), key=repr)
    assert blocked(spark.createDataFrame([], "id long, text string"), 4).count() == 0
