"""Licence scan by a positional rare-token index (DataFrame functions only).

The index holds, for each template, the word of its mandatory key phrase that is rarest in the corpus (highest IDF), with
its place in the template. A file's hits on these words are looked up: a hit and a posting fix the place where the template
would start. There the template's other postings are intersected with the file by relative position; a template is found
where words of LEAST_SHARE of its weight (their IDF) agree and, looked at last, its key phrase stands word by word. A key
phrase can't stand without its rarest word, so the lookup misses none, however many licence words a file holds.

Scale: two scans. The first counts in how many files each vocabulary word stands: one row per word, a fixed bound. The
second is row-local: no shuffle, no table, and a hit costs the length of a template at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases, and the notices of public licences that serve as templates: lines that name one, and the
# notices themselves.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    # label, notice, mandatory key phrase
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("epl-2.0", "available under the terms of the eclipse public license 2 0", "eclipse public license"),
    # label, text of the licence, mandatory key phrase
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions of source code must retain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "the author disclaims all warranties"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "foundation either version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "foundation either version 2 of the license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "subject to the terms of the mozilla public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented", "permission is granted to anyone to use this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unencumbered software released into the public domain"),
]
#: Without weight, and not looked up: they stand everywhere.
COMMON = {"the", "of", "to", "and", "or", "a", "in", "is", "for", "with", "this", "are", "into", "any", "by", "under", "use", "0", "2", "3", "4", "v"}
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_SHARE = 0.6


def _anchor(words: list[str]) -> int:
    """The place in a phrase of the word that is looked at first: the longest that isn't common."""
    return max(range(len(words)), key=lambda i: (words[i] not in COMMON, len(words[i]), -i))


def _stands(words: list[str], at: Column) -> Column:
    """Whether the words stand from word `at` of the array column `words` on."""
    ok = at >= 0
    for k, w in enumerate(words):
        ok = ok & (F.get(F.col("words"), (at + k).cast("int")) == w)
    return F.coalesce(ok, F.lit(False))


def _phrase_starts(phrases: list[tuple[list[str], Column, int]]) -> Column:
    """An array of (start, tag) of every phrase among the hits; phrases are (words, tag, places before the phrase)."""
    return F.concat(*(_starts(words, tag, before) for words, tag, before in phrases))


def _starts(words: list[str], tag: Column, before: int) -> Column:
    k = _anchor(words)
    here = F.filter("hits", lambda h: (h["w"] == words[k]) & _stands(words, h["pos"] - k))
    return F.transform(here, lambda h: F.struct((h["pos"] - k - before).alias("start"), tag.alias("tag")))


def _text(x: object) -> str:
    return "'" + x + "'" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x)


def _literal(rows: list[dict]) -> str:
    """An array of structs as SQL; values are words of the templates, numbers, or arrays made so."""
    made = [f"named_struct({', '.join(f"'{k}', {v if isinstance(v, str) and v.startswith('array(') else _text(v)}" for k, v in r.items())})" for r in rows]
    return f"array({', '.join(made)})"


def _place(notice: list[str], key: list[str]) -> int:
    return next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)


def rarest(notice: list[str], key: list[str], idf: dict[str, float]) -> int:
    """The place in the notice of its key phrase's word with the highest IDF (the first of equal ones)."""
    at = _place(notice, key)
    return max((i for i in range(at, at + len(key)) if notice[i] not in COMMON), key=lambda i: (idf[notice[i]], -i))


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(id_col).alias("doc_id"), F.array_remove(F.split(text, SEPARATORS), "").alias("words"))


def inverse_frequencies(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """log(1 + rows / rows that hold the word) over all rows, of each word; a word no row holds counts as held by one."""
    held = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    counts = _words(docs, id_col, text_col).select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w")).groupBy("w").count()
    found = {r[0]: r[1] for r in counts.collect()}  # at most a row per vocabulary word, and one for all rows
    total = found.pop("", 0)
    return {w: math.log(1 + total / found.get(w, 1)) if total else 1.0 for w in vocabulary}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a found template's weight that agrees, 0.5 if only base phrases stand, else 0. A null or
    empty text has no words, no labels and score 0. Repeated rows are scanned each; an empty table gives an empty result; a
    null doc_id stays null. Other columns aren't read.
    """
    notices = [(label, notice.split(), key.split()) for label, notice, key in TEMPLATES]
    vocabulary = sorted({w for _, notice, _ in notices for w in notice} - COMMON)
    idf = inverse_frequencies(docs, vocabulary, id_col, text_col)
    index, templates = [], []
    for t, (label, notice, key) in enumerate(notices):
        p, at = rarest(notice, key, idf), _place(notice, key)
        index.append({"w": notice[p], "t": t, "p": p})
        posts = [{"p": i, "w": w, "x": float(idf[w])} for i, w in enumerate(notice) if w not in COMMON]
        templates.append({"label": label, "weight": sum(x["x"] for x in posts), "posts": _literal(posts), "key": _literal([{"p": i, "w": notice[i]} for i in range(at, at + len(key))])})
    anchors = {p.split()[_anchor(p.split())] for p in BASE}
    looked_up = sorted({r["w"] for r in index} | anchors)
    marked = F.transform("words", lambda w, i: F.when(w.isin(looked_up), F.struct(i.cast("long").alias("pos"), w.alias("w"))))
    rows = _words(docs, id_col, text_col).withColumn("hits", F.filter(marked, lambda h: h.isNotNull()))
    base = _phrase_starts([(p.split(), F.lit(label), 0) for p, label in BASE.items()])
    rows = rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), "hits", base.alias("base"))
    postings, all_templates = F.expr(_literal(index)), F.expr(_literal(templates))
    # Lookup: each hit with each posting of its word gives a template and the place where it would start.
    met = F.flatten(F.transform("hits", lambda h: F.transform(F.filter(postings, lambda x: x["w"] == h["w"]), lambda x: F.struct(x["t"].alias("t"), (h["pos"] - x["p"]).alias("at")))))
    # Intersection: the weight of the template's words that the file has at the same distance.
    agree = lambda c: F.aggregate(F.get(all_templates, c["t"])["posts"], F.lit(0.0), lambda s, x: s + F.when(F.get("words", (c["at"] + x["p"]).cast("int")) == x["w"], x["x"]).otherwise(0.0))
    shared = F.transform("met", lambda c: F.struct(c["t"].alias("t"), c["at"].alias("at"), F.least(agree(c) / F.get(all_templates, c["t"])["weight"], F.lit(1.0)).alias("share")))
    stands = lambda c: F.forall(F.get(all_templates, c["t"])["key"], lambda x: F.coalesce(F.get("words", (c["at"] + x["p"]).cast("int")) == x["w"], F.lit(False)))
    rows = rows.withColumn("met", met).withColumn("met", shared)
    rows = rows.withColumn("found", F.filter("met", lambda c: (c["share"] >= least_share) & stands(c)))
    base_labels = F.array_distinct(F.transform("base", lambda b: b["tag"]))
    starts = F.transform("base", lambda b: b["start"])
    every = F.array_distinct(F.concat(base_labels, F.transform("found", lambda c: F.get(all_templates, c["t"])["label"])))
    score = F.coalesce(F.array_max(F.transform("found", lambda c: c["share"])), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), score.alias("score"))
