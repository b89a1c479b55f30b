from __future__ import annotations

import math
import random
import re

from llm_data import by_id

from tessera.llm.licenses import COMMON, LEAST_SHARE, TEMPLATES, inverse_frequencies, scan

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    return len(words), sorted((i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def test_edge_rows(edge, edge_rows):
    found = by_id(scan(edge).collect())
    assert len(found) == len(edge_rows)
    for r in edge_rows:
        n, places = brute(r[1] or "")
        mine = found[r[0]]
        assert (mine["n_words"], mine["n_base"]) == (n, len(places))
        assert (mine["first_word"], mine["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert mine["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(mine["base_labels"].split(",")) <= {*mine["labels"].split(","), ""} and 0 <= mine["score"] <= 1


def test_method_labels(spark):
    texts = [
        "Released under the MIT License.",
        "x Licensed under the Apache License, Version 2.0. y",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "REDISTRIBUTION AND USE IN SOURCE AND BINARY FORMS, with or without modification, are permitted",
        "the license of a general public, reserved",
        "license MIT the under released",
    ]
    found = by_id(scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [found[i]["labels"] for i in range(7)] == ["mit", "apache-2.0", "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "bsd", "", ""]


def test_rarer_words_of_a_text_hide_no_notice(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
    prose = "obtaining a binary without modification; the fee, the charge and the documentation, hereby unencumbered, lesser, affero, eclipse, mozilla"
    lines = {"apache-2.0": "Licensed under the Apache License, Version 2.0", "mit": "Licensed under the MIT license"}
    texts, want = [mit, isc, prose], ["mit", "isc", ""]
    for label, line in lines.items():
        for before, also in ((mit, "mit"), (isc, "isc"), (prose, "")):
            texts.append(f"{before} {line}.")
            want.append(",".join(sorted({label, also} - {""})))
    texts += [lines["apache-2.0"], lines["mit"]] * 20
    found = by_id(scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [found[i]["labels"] for i in range(len(want))] == want


def test_rows_stay_whole(irregular, empty):
    df, rows = irregular
    assert scan(df).count() == len(rows) and scan(empty).count() == 0


def whole(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def test_labels_against_brute_force(spark, edge, edge_rows):
    """Every template at every place of every text: notices whole, in part, shuffled, cut at a text's ends, with words put in."""
    rng = random.Random(9)
    texts = [r[1] for r in edge_rows]
    for _, notice, key in TEMPLATES:
        words = notice.split()
        at = notice.index(key)
        mixed = rng.sample(words, len(words))
        texts += [notice.upper(), " ".join(mixed), notice[:at], notice[at:], notice[at : at + len(key)], " ".join(words[: len(words) // 2]), f"x {notice} y {notice}", " ".join(w if rng.random() < 0.7 else "zzz" for w in words), " ".join(words[1:])]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()} - COMMON)
    idf = inverse_frequencies(df, vocabulary)
    for w in vocabulary[::7]:
        n = sum(w in whole(t or "") for t in texts)
        assert math.isclose(idf[w], math.log(1 + len(texts) / max(1, n)))
    found = by_id(scan(df).collect())
    some = 0
    for i, text in rows:
        words, labels, best = whole(text or ""), set(), 0.0
        base = {label for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()}
        for label, notice, key in TEMPLATES:
            notice, key = notice.split(), key.split()
            first = next(k for k in range(len(notice)) if notice[k : k + len(key)] == key)
            weight = sum(idf[w] for w in notice if w not in COMMON)
            for start in (k - first for k in range(len(words)) if words[k : k + len(key)] == key):
                share = sum(idf[w] for k, w in enumerate(notice) if w not in COMMON and 0 <= start + k < len(words) and words[start + k] == w) / weight
                if share >= LEAST_SHARE:
                    labels.add(label)
                    best = max(best, min(1.0, share))
        assert found[i]["labels"] == ",".join(sorted(labels | base)), (i, text[:80])
        assert math.isclose(found[i]["score"], best or (0.5 if base else 0.0), rel_tol=1e-9)
        some += bool(labels)
    assert some > 3 * len(TEMPLATES)


def test_only_ascii_capitals_are_lowered(spark):
    found = scan(spark.createDataFrame([(0, "ALL R\u0130GHTS RESERVED; All Rights Reserved; \u212All rights reserved")], "doc_id long, text string")).first()
    assert (found["n_words"], found["n_base"], found["first_word"]) == (9, 1, 3)
