"""Registered queries of the operators for training data, and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import garble, leaks, mixing, overlap, quota, replies, setjoin
from strandloom.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return replies.defects(table(spark, d, "actor_candidates"))


def p2_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Every label some function voted for, with its posterior."""
    return replies.posteriors(table(spark, d, "actor_candidates"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_overlaps(table(spark, d, "complex_records"))
    return pairs.select(
        F.least("train_no", "eval_no").alias("record_no_a"), F.greatest("train_no", "eval_no").alias("record_no_b")
    )


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "complex_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_pairs(table(spark, d, "gene_groups"), table(spark, d, "complex_records")).select(
        "set_no_a", "set_no_b"
    )


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its class of equal sets and its number of links."""
    return setjoin.similar_records(table(spark, d, "gene_groups"), table(spark, d, "complex_records"))


def _sample(spark: SparkSession, d: str) -> quota.QuotaSample:
    return quota.QuotaSample(
        table(spark, d, "preference_pairs"), "pair_id", "created_at", ["task_type", "evidence_mode"], table(spark, d, "sampling_targets")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets whose quota the sample misses although it holds every row of the category."""
    return _sample(spark, d).report().where("gap > 0 and sampled = available").select("dimension", "category")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report()


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).sample().select(F.col("key").alias("pair_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "benchmark_items")).select("item_id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose documents in the mixture, used as often as allowed, stay below their demand."""
    shares = mixing.shares(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))
    return shares.where("taken < wanted").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the emitted mixture reaches."""
    return mixing.shares(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garble.restored(table(spark, d, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garble.restored(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_posteriors, p4_found, p4_report, p5_found, p5_records, p6_found, p6_report, p6_sample,
        p7_found, p7_report, p8_found, p8_shares, p8_mixture, p9_found, p9_restored,
    )
}

_SETS = r"""
sets AS (SELECT no, kind, list_sort(list_distinct(list_filter(list_transform(gene_ids,
           lambda x: regexp_replace(upper(trim(x, E' \t\n\r')), '\.[0-9]+$', '')), lambda x: x IS NOT NULL AND x <> ''))) AS items
         FROM (SELECT DISTINCT ON (no) * FROM ({rows}) ORDER BY no, upd DESC)),
item AS (SELECT no, kind, len(items) AS n, unnest(items) AS g FROM sets),
shared AS (SELECT a.no AS x, b.no AS y, a.kind AS kx, b.kind AS ky, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o
           FROM item a JOIN item b ON a.g = b.g AND a.no < b.no AND b.n BETWEEN {t} * a.n - 1e-9 AND a.n / {t} + 1e-9
           GROUP BY ALL HAVING o >= {t} * (nx + ny - o) - 1e-9)
"""

_P5 = _SETS.format(
    rows="SELECT group_no AS no, 'g' AS kind, gene_ids, created_at AS upd FROM gene_groups UNION ALL SELECT record_no, 'r', gene_ids, updated_at FROM complex_records",
    t="0.6",
)

_P4 = _SETS.format(rows="SELECT record_no AS no, 'r' AS kind, gene_ids, updated_at AS upd FROM complex_records", t="0.8")
_P4_PAIRS = rf"""
{_P4},
rec AS (SELECT record_no AS no,
          CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'val' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test' END AS split,
          lower(trim(source)) AS source,
          regexp_replace(lower(trim(complex_record_id, E' \t\n\r')), '_0+([0-9]+)$', '_\1') AS idkey
        FROM (SELECT DISTINCT ON (record_no) * FROM complex_records ORDER BY record_no, updated_at DESC)),
near AS (SELECT x, y FROM shared UNION
         SELECT least(a.no, b.no), greatest(a.no, b.no) FROM rec a JOIN rec b ON a.idkey = b.idkey AND a.no <> b.no AND a.idkey <> ''),
pairs AS (SELECT n.x, n.y, CASE WHEN a.split = 'train' THEN n.y ELSE n.x END AS eval_no
          FROM near n JOIN rec a ON a.no = n.x JOIN rec b ON b.no = n.y
          WHERE (a.split = 'train' AND b.split IN ('val', 'test')) OR (b.split = 'train' AND a.split IN ('val', 'test')))
"""

_TARGETS = """
clean AS (SELECT DISTINCT ON (pair_id) pair_id, lower(trim(task_type)) AS t, lower(trim(evidence_mode)) AS m
          FROM preference_pairs ORDER BY pair_id, created_at DESC),
held AS (SELECT 'task_type' AS dimension, t AS category FROM clean UNION ALL SELECT 'evidence_mode', m FROM clean
         UNION ALL SELECT 'task_type|evidence_mode', t || '|' || m FROM clean),
have AS (SELECT dimension, category, count(*) AS n FROM held GROUP BY ALL),
goal AS (SELECT s.dimension, s.category, greatest(s.min_rows, ceil(round(s.target_share *
           floor(round(s.sample_fraction * (SELECT count(*) FROM clean), 6)), 6))) AS quota, coalesce(h.n, 0) AS n
         FROM sampling_targets s LEFT JOIN have h USING (dimension, category))
"""

ORACLE = {
    "p4_found": f"WITH {_P4_PAIRS} SELECT x AS record_no_a, y AS record_no_b FROM pairs",
    "p4_report": f"""WITH {_P4_PAIRS}, hit AS (SELECT eval_no AS no, count(*) AS n FROM pairs GROUP BY ALL)
SELECT split, source, count(*) AS n_records, count(h.n) AS n_leaked, coalesce(sum(h.n), 0) AS n_pairs
FROM rec LEFT JOIN hit h USING (no) WHERE split IN ('val', 'test') GROUP BY split, source""",
    "p5_found": f"WITH {_P5} SELECT x AS set_no_a, y AS set_no_b FROM shared WHERE kx = 'g' OR ky = 'g'",
    "p5_records": f"""WITH {_P5}, cls AS (SELECT no, kind, min(no) OVER w AS class_no, count(*) OVER w AS copies,
  bool_or(kind = 'g') OVER w AS wanted FROM sets WHERE len(items) > 0 WINDOW w AS (PARTITION BY items)),
pairs AS (SELECT DISTINCT a.class_no AS p, b.class_no AS q FROM shared s JOIN cls a ON a.no = s.x JOIN cls b ON b.no = s.y
          WHERE a.class_no <> b.class_no AND (a.wanted OR b.wanted)),
deg AS (SELECT c, count(DISTINCT o) AS links FROM (SELECT p AS c, q AS o FROM pairs UNION ALL SELECT q, p FROM pairs) GROUP BY c)
SELECT no AS set_no, class_no, copies, coalesce(links, 0) AS links FROM cls LEFT JOIN deg ON c = class_no""",
    "p6_found": f"WITH {_TARGETS} SELECT dimension, category FROM goal WHERE n < quota",
    "p7_found": r"""
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM benchmark_items),
runs AS (SELECT DISTINCT item_id, ' ' || array_to_string(ws[k + 1:k + 15], ' ') || ' ' AS run
         FROM (SELECT item_id, ws, unnest(range(len(ws) - 14)) AS k FROM w WHERE len(ws) >= 15)),
dw AS (SELECT doc_id, string_split(trim(t), ' ') AS ws FROM d),
dr AS (SELECT doc_id, ' ' || array_to_string(ws[k + 1:k + 15], ' ') || ' ' AS run
       FROM (SELECT doc_id, ws, unnest(range(len(ws) - 14)) AS k FROM dw WHERE len(ws) >= 15))
SELECT DISTINCT item_id, doc_id FROM runs JOIN dr USING (run)
""",
    "p7_report": r"""
WITH w AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM (SELECT DISTINCT ON (item_id) * FROM benchmark_items)),
ir AS (SELECT item_id, k, array_to_string(ws[k + 1:k + 15], ' ') AS run FROM (SELECT item_id, ws, unnest(range(len(ws) - 14)) AS k FROM w WHERE len(ws) >= 15)),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM documents WHERE text IS NOT NULL),
dr AS (SELECT doc_id, p, array_to_string(ws[p + 1:p + 15], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(len(ws) - 14)) AS p FROM d WHERE len(ws) >= 15)),
hit AS (SELECT DISTINCT item_id, doc_id, k, p - k AS g FROM ir JOIN dr USING (run)),
isl AS (SELECT *, k - row_number() OVER (PARTITION BY item_id, doc_id, g ORDER BY k) AS part FROM hit),
runs AS (SELECT item_id, doc_id, count(*) + 14 AS n FROM isl GROUP BY item_id, doc_id, g, part)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(n)::INT AS longest FROM runs GROUP BY item_id
""",
    "p8_found": r"""
WITH d AS (SELECT lower(trim(source)) AS source, coalesce(len(string_split_regex(trim(text), '\s+')), 0) AS n FROM documents WHERE trim(source) <> ''),
s AS (SELECT source, sum(n) AS n FROM d GROUP BY source)
SELECT m.source FROM mix_targets m LEFT JOIN s USING (source)
WHERE m.max_repeats * coalesce(s.n, 0) < m.target_weight * (SELECT sum(n) FROM s)
""",
}
