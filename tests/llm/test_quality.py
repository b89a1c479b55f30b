from __future__ import annotations

import zlib

import numpy as np
from oracle import DATA

from tessera.llm import registry
from tessera.llm.quality import CoTrained, fit_views, keep_good, page_features, score, text_features, text_scores


def test_held_out_accuracy(spark):
    """Labelled documents beyond the bounded sample."""
    folder = DATA.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = labels.where("doc_id % 3 <> 0")
    found = score(docs, known, max_labelled=1200).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = np.mean([r["keep"] == (r["quality"] == 1) for r in found])
    kept = np.mean([r["keep"] for r in found if r["quality"] == 1])
    assert right > 0.97 and kept > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_lookup_scores_are_the_linear_model():
    rng = np.random.default_rng(0)
    texts = [b"", b"a", b"Some Text!! | twice\ntwice twice", "né ù".encode(), b"x" * 5000, b"q w " * 900]
    features = text_features(texts)
    weights = rng.normal(size=features.shape[1])
    assert np.allclose(features @ weights + 0.5, text_scores(texts, weights, 0.5), atol=1e-4)


def test_reruns_agree_and_all_rows_are_scored(spark):
    one, two = (sorted(registry.queries()["op2_quality"](spark, DATA).collect()) for _ in range(2))
    assert one == two and len(one) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_edge_rows(spark, edge, irregular, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["score"] == 1 and r["keep"] for r in score(edge, none).collect())
    marks = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (3, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    df, rows = irregular
    assert score(df, marks).count() == len(rows)
    kept = keep_good(df, marks)
    assert kept.columns == df.columns and kept.count() <= len(rows)
    assert score(empty, marks).count() == 0 and keep_good(empty, marks).count() == 0


def test_page_view_learns_from_the_text_view():
    """A view that the labels teach little learns from rows marked for it."""
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 2, 1200)
    views = tuple((truth[:, None] * 1.5 + rng.normal(size=(1200, n))).astype(np.float32) for n in (5, 4))
    of = np.where(np.arange(1200) < 80, -1, np.arange(1200) % 2)
    ones = np.ones(1200)
    model = fit_views(views, truth, of, ones, np.arange(1200) % 4 == 0)
    for w, b, v in zip(model.weights, model.bias, views, strict=True):
        assert ((v @ w + b > 0) == truth).mean() > 0.85
    assert fit_views(views, np.ones(1200, int), of, ones, np.arange(1200) % 4 == 0) is None


def test_models_survive_the_way_to_the_driver():
    rng = np.random.default_rng(2)
    texts = [b"a b c", b"x " * 50, b""]
    n_text, n_page = text_features(texts).shape[1], page_features(texts, ["en"] * 3, ["a"] * 3).shape[1]
    model = CoTrained([rng.normal(size=n_text), rng.normal(size=n_page)], [0.1, 0.2], [(1.0, 0.5), (2.0, -0.5)], [0.4, 0.6], 0.7, 0.3)
    assert CoTrained.unpacked(model.packed()).worth == [0.4, 0.6]
    again = CoTrained.unpacked(model.packed())
    for a, b in zip(model.scores(texts, ["en"] * 3, ["a"] * 3), again.scores(texts, ["en"] * 3, ["a"] * 3), strict=True):
        assert np.allclose(a, b)


def test_rounds_against_brute_force(spark):
    """Co-training with plain lists over all documents: the same marks, so the same scores."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    settings = {"rounds": 2, "per_round": 20, "confident": 0.9}
    found = {r["doc_id"]: r["score"] for r in score(docs, labels, max_labelled=150, **settings).collect()}
    rows = {r["doc_id"]: ((r["text"] or "").encode(), r["lang"], r["source"]) for r in docs.collect()}
    order = [r["doc_id"] for r in labels.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").collect() if r["doc_id"] in rows][:150]
    y_of = {r["doc_id"]: r["quality"] for r in labels.collect()}
    table = [(-1, y_of[i], i, 1.0) for i in order]

    def fitted():
        own = sorted(table, key=lambda r: (r[0], zlib.crc32(str(r[2]).encode()), r[1]))
        parts = [rows[r[2]] for r in own]
        x = text_features([p[0] for p in parts]), page_features(*map(list, zip(*parts, strict=True)))
        return fit_views(x, np.array([r[1] for r in own]), np.array([r[0] for r in own]), np.array([r[3] for r in own]), np.arange(len(own)) % 4 == 0)

    model = fitted()
    for _ in range(settings["rounds"]):
        pool = [i for i in rows if i not in {r[2] for r in table}]
        odds = model.odds(*map(list, zip(*(rows[i] for i in pool), strict=True)))
        good = round(settings["per_round"] * model.share)
        fresh = []
        for k in (0, 1):
            for y, n in ((1, good), (0, settings["per_round"] - good)):
                sure = sorted((-(o if y else -o), i) for o, i in zip(odds[k], pool, strict=True))
                fresh += [(1 - k, y, i, model.worth[k]) for s, i in sure[:n] if -s >= np.log(0.9 / 0.1)]
        table += fresh
        model = fitted()
    assert any(r[0] >= 0 for r in table)  # something was exchanged
    expected = model.scores(*map(list, zip(*rows.values(), strict=True)))[2]
    assert np.allclose([found[i] for i in rows], expected, atol=1e-6)
