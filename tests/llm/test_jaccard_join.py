from __future__ import annotations

import random

from llm_data import by_id

from tessera.llm.components import components
from tessera.llm.jaccard_join import drop_near, near_components
from tessera.llm.scratch import Scratch


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def brute(rows, need=75):
    sets = {r[0]: shingles(r[1]) for r in rows}
    union, ids = Union(sets), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= need * (len(sets[a]) + len(sets[b]) - shared):
                union.join(a, b)
    return {i: (len(sets[i]), union.find(i)) for i in ids}


def test_edge_rows(edge, edge_rows):
    found = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(near_components(edge).collect()).items()}
    assert found == brute(edge_rows)


def test_chains_of_edits_and_shared_passages(spark):
    """Similarities around the threshold, and groups that link only in chains."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(40)], []
    for _ in range(12):
        text = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, 14)):
            rows.append((len(rows), " ".join(text if rng.random() < 0.7 else [*text, *passage])))
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(text))
                if rng.random() < 0.5:
                    del text[k]
                else:
                    text[k] = word()
    for _ in range(40):
        rows.append((len(rows), " ".join([*passage, *(word() for _ in range(rng.randint(0, 25)))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for need in (75, 60, 90):
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_components(df, need=need).collect()}
        assert found == brute(rows, need)


def test_repeated_rows_and_null_ids(irregular, empty):
    df, rows = irregular
    found = near_components(df).collect()
    assert len(found) == len(rows)
    assert len({r["component_id"] for r in found if r["doc_id"] == rows[3][0] and r["n_shingles"]}) <= 1
    left = drop_near(df)
    assert left.columns == df.columns
    texts = [r["text"] for r in left.collect() if shingles(r["text"])]
    assert len(texts) == len(set(texts))
    assert near_components(empty).count() == 0 and drop_near(empty).count() == 0


def test_drop_near_keeps_the_smallest_id(edge, edge_rows):
    want = {c for _, c in brute(edge_rows).values()}
    assert {r["doc_id"] for r in drop_near(edge).collect()} == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (150, 200), (7, 7)]
    found = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}
