from __future__ import annotations

import math
from collections import Counter

from llm_data import by_id

from tessera.llm.language_model import lm_scores


def brute(rows):
    texts = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    grams = lambda w: Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    total = Counter()
    for _, w in texts:
        total.update(grams(w))
    n = sum(len(w) for _, w in texts)
    out = {}
    for i, w in texts:
        own, score = grams(w), 0.0
        c = lambda *g, own=own: total[g] - own[g]
        for k, x in enumerate(w):
            if k >= 2 and c(w[k - 2], w[k - 1], x) > 0:
                p = c(w[k - 2], w[k - 1], x) / c(w[k - 2], w[k - 1])
            elif k >= 1 and c(w[k - 1], x) > 0:
                p = c(w[k - 1], x) / c(w[k - 1]) * (0.4 if k >= 2 else 1)
            else:
                p = max(1, c(x)) / max(1, n - len(w)) * 0.4 ** min(k, 2)
            score += math.log(p)
        out[i] = (len(w), score)
    return out


def test_edge_rows(edge, edge_rows):
    want = brute(edge_rows)
    for sizes in ({}, {"block_chars": 3000, "part_keys": 500}):
        found = by_id(lm_scores(edge, **sizes).collect())
        assert len(found) == len(edge_rows)
        for i, (n, score) in want.items():
            assert found[i]["n_words"] == n and math.isclose(found[i]["log_score"], score, rel_tol=1e-9, abs_tol=1e-9)
            assert found[i]["mean_log_score"] is None if n == 0 else math.isclose(found[i]["mean_log_score"], score / n, rel_tol=1e-9, abs_tol=1e-9)


def test_rows_stay_whole(irregular, empty):
    df, rows = irregular
    assert lm_scores(df).count() == len(rows) and lm_scores(empty).count() == 0


def test_words_whose_hashes_agree_in_the_low_bits_are_counted_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from tessera.llm import language_model
    from tessera.llm.blocks import pack, sum_rows, sums_in_order

    keys = np.array([(1 << 41) + 5, (1 << 42) + 5, (1 << 42) + 5, (1 << 63) + 5], np.uint64)
    monkeypatch.setattr(language_model.Block, "grams", lambda self, order: (np.arange(4), keys))

    class Docs:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, each, _):
            numbers = pack(np.zeros(1, "<i8"), np.ones(1, "u1"), np.full(1, 7, "<i8"))
            return each(pa.table({"block": [0], "n": [1], "size": [7], "numbers": [numbers], "texts": [pa.compress(b"a b c d", codec="zstd", asbytes=True)]}))

    sent = language_model._counts(Docs(), 3)
    sums = [sum_rows(sent.filter(pc.equal(sent.column("part"), p))) for p in range(3) if p in sent.column("part").to_pylist()]
    assert sums_in_order(pa.concat_tables(sums), 0, 3).tolist() == [1, 2, 1]
