from __future__ import annotations

import hashlib
import random
from itertools import combinations

import numpy as np
from llm_data import by_id

from oracle import DATA

from tessera.llm.fingerprints import fingerprints, near_duplicates, signatures, with_next
from tessera.llm.shingles import SLICE_BYTES, shingle_sets


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_edge_rows(edge, edge_rows):
    found = by_id(with_next(edge, task_bytes=20_000).collect())
    rows = sorted(edge_rows)
    assert len(found) == len(rows)
    errors = []
    for k, r in enumerate(rows):
        text, following = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        mine = found[r[0]]
        assert mine["n_chars"] == len(text) and mine["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in (("near_edited", edited), ("near_next", following)):
            if shingles(text) or shingles(other):
                errors.append(mine[near] - jaccard(shingles(text), shingles(other)))
            else:
                assert mine[near] == 1
    assert np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.02


def test_equal_texts_have_equal_fingerprints(irregular, empty):
    df, rows = irregular
    found = with_next(df).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    prints = {}
    for r in found:
        if r["doc_id"] in texts:
            assert prints.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    assert with_next(empty).count() == 0


def test_one_document_is_its_own_neighbour(spark):
    r = with_next(spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1


def test_slices_do_not_matter():
    texts = [b"a b c d e f g " * 9000, b"", b"x", b"p q r s t u v w " * 20_000, "é è ".encode() * 50]
    assert sum(map(len, texts)) > SLICE_BYTES / 4
    assert (signatures(texts) == np.concatenate([signatures([t]) for t in texts])).all()


def test_shingle_sets_are_the_distinct_shingles(edge_rows):
    texts = [(r[1] or "") for r in edge_rows]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]


def test_near_duplicates_are_verified(edge, edge_rows):
    texts = {r[0]: r[1] or "" for r in edge_rows}
    found = near_duplicates(edge).collect()
    assert all(abs(r["jaccard"] - jaccard(shingles(texts[r["doc_id"]]), shingles(texts[r["near_id"]]))) < 1e-9 and r["jaccard"] >= 0.75 for r in found)
    copies = [i for i, t in texts.items() if t.startswith("Copy ")]
    assert {r["doc_id"] for r in found if r["near_id"] == min(copies)} >= set(copies) - {min(copies)}


def connected(ids, links):
    label = {i: i for i in ids}
    for a, b in links:
        x, y = sorted((label[a], label[b]))
        label = {i: x if c == y else c for i, c in label.items()}
    return label


def test_near_documents_that_share_a_band_are_connected(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(4):  # copies edited again and again: near their neighbours, less and less near the smallest id
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(12):
            texts.append(" ".join(words))
            for _ in range(2):
                words[rng.randrange(100)] = f"w{rng.randrange(10**6)}"
    perms, rows = 24, 2
    marks = signatures([t.encode() for t in texts], perms).reshape(len(texts), -1, rows)
    sets = [shingles(t) for t in texts]
    near = {(b, a): jaccard(sets[a], sets[b]) for a, b in combinations(range(len(texts)), 2) if (marks[a] == marks[b]).all(axis=1).any()}
    near = {p: j for p, j in near.items() if j >= 0.75}
    found = {(r["doc_id"], r["near_id"]): r["jaccard"] for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), perms=perms, band_rows=rows).collect()}
    assert all(abs(near[p] - j) < 1e-9 for p, j in found.items())
    assert connected(range(len(texts)), found) == connected(range(len(texts)), near)


def test_recall_of_near_duplicates(spark):
    """Of all pairs of 0.75 and more in a real table, by brute force over shared shingles, nine in ten are connected."""
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, shared = {}, {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for ids in holders.values():
        for a, b in combinations(ids, 2):
            shared[a, b] = shared.get((a, b), 0) + 1
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.75 * (len(sets[a]) + len(sets[b]) - n)]
    label = connected(texts, [(r["doc_id"], r["near_id"]) for r in near_duplicates(docs).collect()])
    assert len(near) > 50 and sum(label[a] == label[b] for a, b in near) >= 0.9 * len(near)


def test_near_duplicates_of_odd_tables(irregular, empty, spark):
    df, rows = irregular
    found = near_duplicates(df).collect()
    assert all(r["doc_id"] is not None and r["near_id"] < r["doc_id"] for r in found) and len({(r["doc_id"], r["near_id"]) for r in found}) == len(found)
    assert near_duplicates(empty).count() == 0 and fingerprints(empty).count() == 0
    assert fingerprints(df).count() == len(rows)
