"""Secret scan: pattern spans, and spans found by token efficiency.

Ordinary words and identifiers are cheap in a trained vocabulary: several characters a token. Random strings are
not. A run of key-like characters is exposed where its characters per token fall below ``RATIO``, unless it is a
known digest (hex of a standard digest's length, a UUID) or an identifier: words joined by case, digits or separators
that are cheap by themselves. Of a run that isn't exposed as a whole, such as a path of words and a key, the parts
between separators are tested, alone and with their neighbours. Spans are code points, end exclusive. The scan is row-local: no shuffle, one scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A key-like run; one with no letter is a number to this scan.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})(?:[_/=+-]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4}))*[_/=+-]*")
WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
PART = re.compile(r"[A-Za-z0-9]+")
#: A part between separators that says nothing of its neighbours: short, or a number of an identifier.
NEUTRAL = re.compile(r"[A-Za-z0-9]{1,3}|[0-9]{4}")
RATIO = 2.2
MIN_CHARS = 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns; leftmost, non-overlapping within a kind, failing matches dropped.

    Runs are greedy, so a lower bound in the pattern drops the same matches as a test of the whole run afterwards.
    """
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_random(run: str, encode, ratio: float = RATIO, min_chars: int = MIN_CHARS) -> bool:
    if len(run) < min_chars or not any(c.isalpha() for c in run):
        return False
    if DIGEST.fullmatch(run) or UUID.fullmatch(run) or len(run) >= ratio * len(encode(run)):
        return False
    return not (IDENTIFIER.fullmatch(run) and _cheap(WORDS.findall(run), encode, ratio))


def _cheap(words: list[str], encode, ratio: float) -> bool:
    return sum(map(len, words)) >= ratio * sum(len(encode(w)) for w in words)


def _random_parts(run: str, encode, ratio: float, min_chars: int) -> list[tuple[int, int]]:
    """The exposed parts of a run that isn't exposed as a whole: neighbours that aren't words together, else each alone."""
    groups: list[list[tuple[int, int]]] = []  # costly parts in a row
    wide: list[list[int]] = []  # the same with the neutral parts and separators around them
    open_, lead = False, 0
    for m in PART.finditer(run):
        a, b = m.span()
        if NEUTRAL.fullmatch(run, a, b):
            continue
        if _cheap([m[0]], encode, ratio) or (IDENTIFIER.fullmatch(m[0]) and _cheap(WORDS.findall(m[0]), encode, ratio)):
            if open_:
                wide[-1][1] = a - 1
            open_, lead = False, min(b + 1, len(run))
        elif open_:
            groups[-1].append((a, b))
        else:
            groups.append([(a, b)])
            wide.append([lead, len(run)])
            open_ = True
    found = []
    for group, around in zip(groups, wide, strict=True):
        for a, b in ((group[0][0], group[-1][1]), tuple(around)):
            if is_random(run[a:b], encode, ratio, min_chars):
                found.append((a, b))
                break
        else:
            found += [p for p in group if is_random(run[slice(*p)], encode, ratio, min_chars)]
    return found


def method_spans(text: str, encode, ratio: float = RATIO, min_chars: int = MIN_CHARS) -> list[tuple[int, int, int]]:
    found = []
    for m in RUN.finditer(text):
        if is_random(m[0], encode, ratio, min_chars):
            found.append((m.start(), 3, m.end()))
        elif len(m[0]) > min_chars and not (DIGEST.fullmatch(m[0]) or UUID.fullmatch(m[0])):
            found += [(m.start() + a, 3, m.start() + b) for a, b in _random_parts(m[0], encode, ratio, min_chars)]
    return found


def load_encode(ranks_path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


SPANS = "doc_id long, kind array<string>, start array<long>, end array<long>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, ratio: float = RATIO, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, kind, start, end): parallel arrays of all spans, by start and then kind.

    A null or empty text has none; repeated rows are scanned each; an empty table gives an empty result; a null
    doc_id stays null; other columns aren't read. Whole texts are scanned, however long.
    """
    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encode(ranks_path)
        for batch in batches:
            kinds, starts, ends = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = sorted(base_spans(text) + method_spans(text, encode, ratio, min_chars))
                kinds.append([KINDS[k] for _, k, _ in spans])
                starts.append([a for a, _, _ in spans])
                ends.append([b for _, _, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["doc_id", "kind", "start", "end"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, SPANS)


def redact(docs: DataFrame, mark: str = "[REDACTED]", id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """The documents with every span of either way replaced by mark; spans that overlap share one.

    A null text stays null, an empty one empty; repeated rows are treated each; an empty table gives an empty one; other
    columns, whatever their names, and ids, null or not, stay as they are.
    """
    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    import pandas as pd

    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_encode(ranks_path)
        for series in texts:
            yield series.map(lambda t: t if t is None else _cover(t, base_spans(t) + method_spans(t, encode), mark))

    clean.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))


def _cover(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. See scan for nulls and ties."""
    s = scan(docs, id_col, text_col, ranks_path)
    s = s.select("doc_id", F.transform(F.arrays_zip("kind", "start", "end"), lambda x: F.struct(x["kind"].alias("kind"), F.concat_ws(":", x["kind"], x["start"], x["end"]).alias("at"))).alias("all"))
    count = lambda kind: F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("all", lambda x: x["kind"] != "random")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: x["at"]), ",")
    return s.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
