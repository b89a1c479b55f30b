"""Quality classifier by co-training on two views of a document.

The text view sees the words and the character classes of the text. The page view sees what a crawler knows of a page
without reading it: language, source, and how many bytes and lines of what length it has. Each is a logistic regression.
From a labelled seed, each round trains and calibrates both; each then marks the documents of the whole corpus that it is
surest of, in the proportions of the labels and only where its calibrated probability is CONFIDENT, and the other learns
from them. A mark weighs as much as the view that set it is worth: the share of the prior's log loss that it takes away
on held-out labels. At last both are calibrated on labelled documents held out from training, and their log odds are added (less
the prior's, which both hold) to score.

Scale: the seed is a bounded sample of labelled rows (MAX_LABELLED, those with the least hash of their id). Pseudo-labels
come from all other documents: every round scans the corpus, each task keeps the surest of its rows, and what the tasks
kept is cut to the surest of all in two levels. Models are fitted in one executor task, on 1 row per seed document and
pseudo-label: at most MAX_LABELLED + 2 * ROUNDS * PER_ROUND, of fixed size. The driver holds ids of these and the weights.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .shingles import SLICE_BYTES, slices, word_hashes

MAX_LABELLED = 4000
ROUNDS = 3
PER_ROUND = 200
CONFIDENT = 0.98
THRESHOLD = 0.5
BUCKETS = 64
WORD_DIMS = 1024
HASHED = 64
_CLASSES = 12


def _class_table() -> np.ndarray:
    table = np.full(256, 11, np.int64)  # other signs
    table[ord("A") : ord("Z") + 1] = 0
    table[ord("a") : ord("z") + 1] = 1
    table[128:] = 2
    table[ord("0") : ord("9") + 1] = 3
    for i, chars in enumerate((b" \t", b"\n\r", b".", b",;:", b"!?", b"|", b"\"'()-")):
        table[list(chars)] = 4 + i
    return table


_CLASS = _class_table()
TEXT_DIMS = WORD_DIMS + _CLASSES**3 + 2
SIZE_BINS = 48
PAGE_DIMS = 2 * HASHED + 3 * SIZE_BINS


def _places(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, repeats of the word before, and class trigrams: (feature at each place, first and last + 1 of each text)."""
    words, first = word_hashes(texts, lower=False)
    again = TEXT_DIMS - 2 + (words == np.roll(words, 1)).astype(np.int64)
    again[first[:-1][np.diff(first) > 0]] = TEXT_DIMS - 2
    yield (words >> np.uint64(54)).astype(np.int64), first[:-1], first[1:]
    yield again, first[:-1], first[1:]
    data = _CLASS[np.frombuffer(b"".join(t + b"\n\n\n" for t in texts), np.uint8)]
    tri = (data[:-2] * _CLASSES + data[1:-1]) * _CLASSES + data[2:]
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size + 3) - size - 3
    yield WORD_DIMS + tri, start, start + size + 1


def text_features(texts: list[bytes]) -> np.ndarray:
    """Relative frequencies of words, repeats and class trigrams: (texts, TEXT_DIMS)."""
    out = np.zeros((len(texts), TEXT_DIMS), np.float32)
    for i, t in enumerate(texts):
        for feature, start, end in _places([t]):
            if end[0] > start[0]:
                out[i] += np.bincount(feature[start[0] : end[0]], minlength=TEXT_DIMS) / np.float32(end[0] - start[0])
    return out


def text_scores(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """text_features(texts) @ weights + bias, by lookup."""
    out = np.full(len(texts), bias)
    for a, b in slices(texts, SLICE_BYTES):
        for feature, start, end in _places(texts[a:b]):
            total = np.append(0.0, np.cumsum(weights[feature]))
            out[a:b] += (total[end] - total[start]) / np.maximum(end - start, 1)
    return out


def page_features(texts: list[bytes], langs: list, sources: list) -> np.ndarray:
    """Language, source, and in steps of half a power of two: bytes, lines, bytes of the longest line. (texts, PAGE_DIMS)."""
    out = np.zeros((len(texts), PAGE_DIMS), np.float32)
    step = lambda n: min(SIZE_BINS - 1, int(2 * np.log2(n + 1)))
    for i, (t, lang, source) in enumerate(zip(texts, langs, sources, strict=True)):
        ends = np.flatnonzero(np.frombuffer(t + b"\n", np.uint8) == 10)
        sizes = (len(t), len(ends), int(np.diff(ends, prepend=-1).max()))
        at = [zlib.crc32(f"l:{lang}".encode()) % HASHED, HASHED + zlib.crc32(f"s:{source}".encode()) % HASHED]
        out[i, [*at, *(2 * HASHED + k * SIZE_BINS + step(n) for k, n in enumerate(sizes))]] = 1
    return out


class Logistic:
    """Ridge logistic regression on scaled features, by full-batch accelerated gradient."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 120):
        self.scale = 1 / np.maximum(x.std(axis=0), 1e-3 * max(1e-6, float(x.std(axis=0).max()))).astype(np.float32)
        self.shift = x.mean(axis=0)
        z = (x - self.shift) * self.scale
        w, v, b, c = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
        rate = 4 / max(1.0, float((z**2).sum(axis=1).mean()) / 8)
        for k in range(steps):
            look_w, look_b = w + k / (k + 3) * (w - v), b + k / (k + 3) * (b - c)
            error = (_sigmoid(z @ look_w.astype(np.float32) + look_b) - y) * weight
            v, c = w, b
            w, b = look_w - rate * (z.T @ error.astype(np.float32) / weight.sum() + ridge * look_w), look_b - rate * error.sum() / weight.sum()
        self.weights = w * self.scale
        self.bias = float(b - self.shift @ self.weights)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and offset, by Newton steps with a little ridge; the slope isn't negative."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    spread = max(1e-6, float(np.abs(odds).mean()))
    x = odds / spread
    for _ in range(50):
        p = _sigmoid(a * x + b)
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(a)) / spread, float(b)


class CoTrained:
    """Both views after a fit, as numbers that can be sent: linear weights, Platt slopes and offsets, what each is worth; share of good, prior."""

    def __init__(self, weights: list[np.ndarray], bias: list[float], scaling: list[tuple[float, float]], worth: list[float], share: float, prior: float):
        self.weights, self.bias, self.scaling, self.worth, self.share, self.prior = weights, bias, scaling, worth, share, prior

    def packed(self) -> bytes:
        return np.concatenate([*self.weights, self.bias, np.ravel(self.scaling), self.worth, [self.share, self.prior]]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> CoTrained:
        x = np.frombuffer(raw, "<f8")
        w, rest = x[: TEXT_DIMS + PAGE_DIMS], x[TEXT_DIMS + PAGE_DIMS :]
        return cls([w[:TEXT_DIMS], w[TEXT_DIMS:]], list(rest[:2]), [(rest[2], rest[3]), (rest[4], rest[5])], list(rest[6:8]), float(rest[8]), float(rest[9]))

    def odds(self, texts: list[bytes], langs: list, sources: list) -> list[np.ndarray]:
        """Calibrated log odds of both views."""
        found = (text_scores(texts, self.weights[0], self.bias[0]), page_features(texts, langs, sources) @ self.weights[1] + self.bias[1])
        return [a * x + b for (a, b), x in zip(self.scaling, found, strict=True)]

    def scores(self, texts: list[bytes], langs: list, sources: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, two = self.odds(texts, langs, sources)
        return _sigmoid(one), _sigmoid(two), _sigmoid(one + two - self.prior)


def fit_views(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, of: np.ndarray, weight: np.ndarray, held: np.ndarray) -> CoTrained | None:
    """Rows with of = -1 are labelled, with 0 or 1 marked for that view alone. None where a class is lacking."""
    if any(not ((of < 0) & (y == k) & h).any() for k in (0, 1) for h in (held, ~held)):
        return None
    check = (of < 0) & held
    prior = float(y[check].mean())
    models, scaling, worth = [], [], []
    for k, view in enumerate(views):
        mine = np.flatnonzero(((of < 0) & ~held) | (of == k))
        models.append(Logistic(view[mine], y[mine], weight[mine]))
        odds = models[-1].odds(view[check])
        scaling.append(_calibrate(odds, y[check]))
        sure = _sigmoid(scaling[-1][0] * odds + scaling[-1][1])
        loss, blind = (-float(np.mean(np.where(y[check] > 0, np.log(p), np.log1p(-p)))) for p in (np.clip(sure, 1e-12, 1 - 1e-12), prior))
        worth.append(max(0.0, 1 - loss / blind))
    return CoTrained([m.weights for m in models], [m.bias for m in models], scaling, worth, float(y[(of < 0) & ~held].mean()), float(np.log(prior / (1 - prior))))


def _columns(docs: DataFrame, id_col: str, text_col: str) -> list:
    """The columns the views read; a table without lang or source has them null."""
    some = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *some]


def _raw(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


ROWS = "of int, y int, weight double, doc_id long, at binary, value binary"
_ROW_NAMES = [f.split()[0] for f in ROWS.split(", ")]


def _sparse(texts: list[bytes], langs: list, sources: list) -> tuple[list[bytes], list[bytes]]:
    rows = np.concatenate([text_features(texts), page_features(texts, langs, sources)], axis=1) if texts else np.zeros((0, 1), np.float32)
    some = [np.flatnonzero(r).astype("<i4") for r in rows]
    return [i.tobytes() for i in some], [r[i].astype("<f4").tobytes() for r, i in zip(rows, some, strict=True)]


def _fitted(rows: DataFrame) -> CoTrained | None:
    """The views fitted to ROWS in one task; they are bounded (see the module). Results don't depend on the rows' order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        found.sort(key=lambda r: (r[0], zlib.crc32(str(r[3]).encode()), *r[1:]))
        of, y, weight = (np.array([r[k] for r in found], kind) for k, kind in enumerate((int, int, float)))
        x = np.zeros((len(found), TEXT_DIMS + PAGE_DIMS), np.float32)
        for i, r in enumerate(found):
            x[i, np.frombuffer(r[4], "<i4")] = np.frombuffer(r[5], "<f4")
        model = fit_views((x[:, :TEXT_DIMS], x[:, TEXT_DIMS:]), y, of, weight, np.arange(len(y)) % 4 == 0)
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([model.packed()], pa.binary())], ["model"])

    made = rows.select(*_ROW_NAMES).coalesce(1).mapInArrow(each, "model binary").collect()
    return CoTrained.unpacked(bytes(made[0][0])) if made else None


def _surest(rows: DataFrame, model: CoTrained, known: np.ndarray, per_round: int, confident: float, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, of, y, weight): the documents outside known that each view is surest of, marked for the other view."""
    n_good = round(per_round * model.share)
    take = {(k, y): n for k in (0, 1) for y, n in ((1, n_good), (0, per_round - n_good))}
    edge = float(np.log(confident / (1 - confident)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple[float, int]]] = {key: [] for key in take}
        for batch in batches:
            free = ~np.isin(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), known) & ~np.asarray(batch.column(0).is_null())
            batch = batch.filter(pa.array(free))
            ids = batch.column(0).to_pylist()
            odds = model.odds(_raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for (k, y), n in take.items():
                sure = odds[k] if y else -odds[k]
                best[k, y] = sorted({*best[k, y], *((-float(sure[i]), ids[i]) for i in np.flatnonzero(sure >= edge))})[:n]
        out = [(doc_id, 1 - k, y, model.worth[k], -less) for (k, y), found in best.items() for less, doc_id in found]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "of", "y", "weight", "sure"])

    found = rows.mapInArrow(each, "doc_id long, of int, y int, weight double, sure double")
    found = found.groupBy("doc_id", "of", "y", "weight").agg(F.max("sure").alias("sure")).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    limit = F.when(F.col("y") == 1, n_good).otherwise(per_round - n_good)
    order = F.col("sure").desc(), F.col("doc_id")
    # The surest of each bucket first: BUCKETS * per_round rows at most are left to merge, however many tasks there were.
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("of", "y", "bucket").orderBy(*order))).where(F.col("k") <= limit)
    best = scratch.keep(best, f"{name}-best")
    tops = [best.where((F.col("of") == 1 - k) & (F.col("y") == y)).orderBy(*order).limit(n) for (k, y), n in take.items()]
    return scratch.keep(reduce(DataFrame.unionByName, tops).select("doc_id", "of", "y", "weight"), name)


def _featured(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """ROWS of the chosen (doc_id, of, y, weight): bounded (see the module), so safe to broadcast. Of repeated ids one row stays."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = _sparse(_raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (4, 5, 6, 0)), pa.array(at, pa.binary()), pa.array(value, pa.binary())], _ROW_NAMES)

    made = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang", "source", "of", "y", "weight").mapInArrow(each, ROWS)
    one = made.groupBy("of", "y", "weight", "doc_id").agg(F.min(F.struct("at", "value")).alias("x"))
    return one.select("of", "y", "weight", "doc_id", "x.at", "x.value")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND, confident: float = CONFIDENT) -> CoTrained | None:
    """The classifier, or None (and a warning in the log) where the labels of the sample lack a class.

    Null labels and ids are skipped. Of several labels of one id the least counts, of several rows of one id the one with
    the least features. Ids are sampled by hash and ties are broken by id, so that a rerun fits the same classifier.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(*_columns(docs, id_col, text_col))
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("y"))
    sample = marked.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = sample.select("doc_id", F.lit(-1).alias("of"), "y", F.lit(1.0).alias("weight"))
    seen = scratch.keep(_featured(rows, sample), "labelled")
    model = _fitted(seen)
    if model is None:
        logging.getLogger(__name__).warning("the labels lack a class: no quality classifier, every document scores 1")
        return None
    for k in range(rounds):
        known = np.array([r[0] for r in seen.select("doc_id").distinct().collect()], np.int64)  # bounded, see the module
        chosen = _surest(rows, model, known, per_round, confident, scratch, f"chosen{k}")
        if chosen.isEmpty():
            break
        seen = seen.unionByName(scratch.keep(_featured(rows, chosen), f"marks{k}"))
        model = _fitted(seen)
    scratch.drop("labelled", *(f"{name}{i}" for i in range(rounds) for name in ("chosen", "marks")), *(f"chosen{i}-best" for i in range(rounds)))
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **sizes: float) -> DataFrame:
    """One row per document: doc_id, p_text, p_page, score (the probability that it is good), keep.

    A null text counts as empty. Without a fit (see fit) every score is 1 and every document stays. Repeated rows are scored
    each; a null doc_id stays null; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col, **sizes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _raw(batch.column(1))
            found = model.scores(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()) if model else (np.ones(len(texts)),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found), pa.array(found[2] >= threshold)], ["doc_id", "p_text", "p_page", "score", "keep"])

    return docs.select(*_columns(docs, id_col, text_col)).mapInArrow(each, "doc_id long, p_text double, p_page double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **sizes: float) -> DataFrame:
    """The documents that score keeps, with their own columns, in the same scan.

    A null text counts as empty and is judged like any other; repeated rows and rows with a null id stay or go each by its
    own text; without a fit (see fit) all documents stay; an empty table gives an empty one.
    """
    model = fit(docs, labels, id_col, text_col, **sizes)
    if model is None:
        return docs
    names = docs.columns
    place = {c: names.index(c) if c in names else None for c in (text_col, "lang", "source")}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = ([None] * batch.num_rows if place[c] is None else batch.column(place[c]).to_pylist() for c in ("lang", "source"))
            good = model.scores(_raw(batch.column(place[text_col])), lang, source)[2] >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(each, docs.schema)
