from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from tessera.llm.exact_dedup import drop_exact, exact_dedup, radix_groups


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return groups


def test_edge_rows(edge, edge_rows):
    groups = brute(edge_rows)
    found = {r["doc_id"]: r for r in exact_dedup(edge).collect()}
    assert len(found) == len(edge_rows)
    for r in edge_rows:
        ids, mine = groups[r[1] or ""], found[r[0]]
        assert mine["keep_id"] == max(ids) and mine["group_size"] == len(ids) and mine["kept"] == (r[0] == max(ids))
        assert mine["text_sha256"] == hashlib.sha256((r[1] or "").encode()).hexdigest()


def test_repeated_rows_and_null_ids(irregular):
    df, rows = irregular
    found = exact_dedup(df).collect()
    assert len(found) == len(rows)
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert len(kept) == len({r[1] or "" for r in rows}) and set(kept.values()) == {1}


def test_narrow_digits_give_the_same_groups(edge):
    """Many rounds of one and two bytes against the usual few."""
    few = {r["doc_id"]: r["keep_id"] for r in radix_groups(edge).collect()}
    many = {r["doc_id"]: r["keep_id"] for r in radix_groups(edge, first_bytes=1, growth=2).collect()}
    assert few == many


def test_drop_keeps_columns_and_one_row(irregular, empty):
    df, rows = irregular
    left = drop_exact(df)
    assert left.columns == df.columns
    assert Counter(r["text"] or "" for r in left.collect()) == dict.fromkeys({r[1] or "" for r in rows}, 1)
    assert drop_exact(empty).count() == 0 and exact_dedup(empty).count() == 0
