from __future__ import annotations

import re
from collections import Counter, defaultdict

from oracle import DATA

from tessera.llm import registry
from tessera.llm.mixing import MIN_BUCKETS, mix, mixed_documents, schedule, source_targets


def targets(sizes, weights=(5, 2, 1), most=3):
    """Resharing round by round, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            out[s] += share * weight[s]
        for s in list(open_):
            if out[s] > most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                open_.discard(s)
    return out


def check(found, rows, slack):
    assert len(found) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], size(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets(sizes)
    source, taken = {}, defaultdict(int)
    for r in rows:
        source.setdefault(r[0], r[3])
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = source[r["doc_id"]]
        if len({x[3] for x in rows if x[0] == r["doc_id"]}) == 1:
            assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack + 0.01 * want[s], (s, taken[s], want[s])


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"], None, r["source"]) for r in docs.collect()]
    one = registry.queries()["op8_mixing"](spark, DATA).collect()
    check(one, rows, 8)
    assert sorted(one) == sorted(registry.queries()["op8_mixing"](spark, DATA).collect())


def test_edge_rows(edge, edge_rows):
    check(mix(edge).collect(), edge_rows, 8)
    check(mix(edge, slots=512, bucket_rows=3).collect(), edge_rows, 8 * 200)


def test_targets_settle_like_rounds_of_resharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"x": 1}, {"a": 0, "b": 9}, {"é": 4, "z": 4, "A": 900, "b": 3, "c": 2}):
        rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = targets(sizes)
        assert {r["source"]: round(r["target"], 6) for r in rows} == {s: round(v, 6) for s, v in want.items()}


def test_schedule_is_even_at_every_point(spark):
    shares = spark.createDataFrame([("a", 0, 1, 5, 500.0), ("b", 1, 1, 2, 300.0), ("c", 2, 1, 1, 200.0)], "source string, ord int, source_size long, weight long, target double")
    found = sorted(schedule(shares, 1000, chunk=64).collect())
    assert [r["t"] for r in found] == list(range(1000))
    seen = Counter()
    for k, r in enumerate(found, 1):
        assert r["rank"] == seen[r["ord"]]
        seen[r["ord"]] += 1
        assert all(abs(seen[o] - k * p) < 6 for o, p in ((0, 0.5), (1, 0.3), (2, 0.2)))


def test_sources_smaller_than_a_block_meet_their_targets(spark):
    sizes = {"a": 60_000, "b": 235, "c": 40, "d": 7, "e": 1, None: 130}
    rows = [(k, "w " * n, s) for k, (s, n) in enumerate((s, n) for s, size in sizes.items() for n in [9] * (size // 9) + [size % 9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = targets(sizes)
    for slots in (16, 300):
        taken = defaultdict(int)
        for r in mix(docs, slots=slots).collect():
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[rows[r["doc_id"]][2]] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes), (slots, taken, want)


def test_rows_stay_whole(irregular, empty):
    df, rows = irregular
    assert mix(df).count() == len(rows) and mix(empty).count() == 0
    assert mixed_documents(df).columns == df.columns and mixed_documents(empty).count() == 0
    assert max(Counter(r["doc_id"] for r in mixed_documents(df).collect() if r["doc_id"] not in (None, rows[3][0], rows[5][0])).values()) <= 3


def test_taken_against_brute_force(edge, edge_rows):
    """A source's documents stand in a line by hash, again and again; the words up to the target are taken."""
    from pyspark.sql import functions as F

    hashes = {r[0]: r[1] for r in edge.select("doc_id", F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))).collect()}
    for bucket_rows in (5, 1 << 16):
        buckets = max(MIN_BUCKETS, -(-len(edge_rows) // bucket_rows))
        found = {r["doc_id"]: r for r in mix(edge, bucket_rows=bucket_rows).collect()}
        for source in {r[3] for r in edge_rows}:
            own = sorted((((hashes[r[0]] >> 20) % buckets, hashes[r[0]], r[0]) for r in edge_rows if r[3] == source))
            size = {i: found[i]["size"] for _, _, i in own}
            left = min(int(found[own[0][2]]["target"] + 0.5), 3 * sum(size.values()))
            taken = dict.fromkeys(size, 0)
            for _ in range(3):
                for _, _, i in own:
                    n = min(left, size[i])
                    taken[i] += n
                    left -= n
            assert {i: found[i]["taken"] for i in size} == taken, (source, bucket_rows)


def test_a_source_a_thousandth_of_a_block(spark):
    rows = [(i, "w " * 1000, None, "big") for i in range(200)] + [(1000 + i, "v " * 20, None, "small") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mix(df, slots=2).collect()
    assert sum(r["taken"] for r in found if r["doc_id"] >= 1000) == 300


def test_mixed_documents_of_odd_tables(irregular, empty, spark):
    df, rows = irregular
    out = mixed_documents(df)
    assert out.columns == df.columns and mixed_documents(empty).count() == 0
    known = Counter((r[0], r[1]) for r in rows)
    made = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert made and all((t or "").split() and n <= 3 * known[i, t] for (i, t), n in made.items())
