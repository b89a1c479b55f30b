"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Python workers import this package: where they may not find it on their path, the session sends it to them."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    at_hand = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    done = getattr(ship, "done", None)
    if str(root) in at_hand or done == spark.sparkContext.applicationId:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in (root / "tessera").rglob("*.py"):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)
    ship.done = spark.sparkContext.applicationId


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import with_next

    return with_next(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir)).drop("text_hash")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_report

    return secret_report(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import lm_scores

    scores = lm_scores(documents(spark, sf_dir))  # rounded beyond what the order of a sum can change
    share = F.col("n_trigram") / F.greatest(F.col("n_words") - 2, F.lit(1))  # of its trigrams, those of other documents
    return scores.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6), "trigram_share": F.round(share, 6)})


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_components

    return near_components(documents(spark, sf_dir))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


_WORDS = r"""w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents)"""

OP9_SQL = f"""
WITH {_WORDS},
t AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, x, lag(x) OVER d AS v, lag(x, 2) OVER d AS u FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i,
        count(*) OVER (PARTITION BY x) - count(*) OVER (PARTITION BY doc_id, x) AS one,
        CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY v, x) - count(*) OVER (PARTITION BY doc_id, v, x) ELSE 0 END AS two,
        CASE WHEN i >= 3 THEN count(*) OVER (PARTITION BY u, v, x) - count(*) OVER (PARTITION BY doc_id, u, v, x) ELSE 0 END AS three,
        greatest(count(*) OVER () - count(*) OVER (PARTITION BY doc_id), 1) AS rest
      FROM g),
m AS (SELECT *, lag(one) OVER d AS one_before, lag(two) OVER d AS two_before FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE three > 0) AS n3, count(*) FILTER (WHERE three = 0 AND two > 0) AS n2,
        sum(ln(CASE WHEN three > 0 THEN three / two_before
                    WHEN two > 0 THEN two / one_before * CASE WHEN i >= 3 THEN 0.4::DOUBLE ELSE 1 END
                    ELSE greatest(one, 1) / rest * pow(0.4::DOUBLE, least(i - 1, 2)) END)) AS score
      FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(n3, 0) AS n_trigram, coalesce(n2, 0) AS n_bigram,
       round(coalesce(score, 0), 4) AS log_score, round(score / n, 6) AS mean_log_score,
       round(coalesce(n3, 0) / greatest(coalesce(n, 0) - 2, 1), 6) AS trigram_share
FROM documents LEFT JOIN s USING (doc_id)
"""

OP10_SQL = f"""
WITH RECURSIVE {_WORDS},
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w) AS x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS least_ FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least_, d.doc_id) AS component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""


OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
m AS (SELECT doc_id, unnest(list_transform(range(0, n - 99), lambda s: md5_number(substr(hx, 2 * s + 1, 200)))) AS x, unnest(range(0, n - 99)) AS s FROM d),
w AS (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM m),
h AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM w WHERE k > 1),
g AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM h),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY doc_id, run),
totals AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS n_spans, max(b) AS last_ FROM spans GROUP BY doc_id),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM spans
           UNION ALL SELECT doc_id, coalesce(last_, 0), n FROM d LEFT JOIN totals USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(hx, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


# What SQL can state of the results of 3, 5, 6 and 8: the same operators, the columns that don't depend on models, hashing
# or a schedule.


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def base_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


BASE_SECRETS_SQL = r"""
SELECT doc_id,
       len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
       len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
       len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM documents
"""

BASE_LICENSES_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n_words,
        list_filter(range(len(ws)), lambda i: ws[i + 1] = 'cc' AND ws[i + 2] = 'by') AS c,
        list_filter(range(len(ws)), lambda i: ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license') AS g,
        list_filter(range(len(ws)), lambda i: ws[i + 1] = 'all' AND ws[i + 2] = 'rights' AND ws[i + 3] = 'reserved') AS r FROM w)
SELECT doc_id, n_words, len(c) + len(g) + len(r) AS n_base, list_min(list_concat(c, g, r)) AS first_word, list_max(list_concat(c, g, r)) AS last_word,
       concat_ws(',', CASE WHEN len(c) > 0 THEN 'cc-by' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(r) > 0 THEN 'reserved' END) AS base_labels
FROM p
"""

BASE_FINGERPRINTS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS f FROM documents)
SELECT doc_id, length(t) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 2) || substring(f, 1, length(t) // 2)) AS edited_sha256 FROM d
"""

BASE_MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
c AS (SELECT *, 3 * source_size / weight AS ratio FROM o),
-- The level at which targets weigh up to the whole, if those sources are capped whose cap lies below it.
l AS (SELECT a.ratio, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * b.source_size) FILTER (WHERE b.ratio < a.ratio), 0)) / sum(b.weight) FILTER (WHERE b.ratio >= a.ratio) AS level FROM c AS a CROSS JOIN c AS b GROUP BY a.source, a.ratio),
v AS (SELECT arg_min(level, ratio) FILTER (WHERE level < ratio) AS level FROM l)
SELECT doc_id, size, source_size, round(CASE WHEN ratio <= (SELECT level FROM v) OR (SELECT level FROM v) IS NULL THEN 3 * source_size ELSE weight * (SELECT level FROM v) END, 3) AS target
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

BASE = {"base_secrets": (base_secrets, BASE_SECRETS_SQL), "base_licenses": (base_licenses, BASE_LICENSES_SQL), "base_fingerprints": (base_fingerprints, BASE_FINGERPRINTS_SQL), "base_mixing": (base_mixing, BASE_MIXING_SQL)}


def queries() -> dict:
    return {"op1_exact_dedup": op1_exact_dedup, "op2_quality": op2_quality, "op3_secrets": op3_secrets, "op4_packing": op4_packing, "op5_licenses": op5_licenses, "op6_fingerprints": op6_fingerprints, "op7_suffix_dedup": op7_suffix_dedup, "op8_mixing": op8_mixing, "op9_lm_scores": op9_lm_scores, "op10_jaccard_join": op10_jaccard_join} | {name: build for name, (build, _) in BASE.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op7_suffix_dedup": OP7_SQL, "op9_lm_scores": OP9_SQL, "op10_jaccard_join": OP10_SQL} | {name: sql for name, (_, sql) in BASE.items()}
