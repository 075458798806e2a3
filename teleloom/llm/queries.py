"""The queries of the llm problems (p1, p8, p9, p10), each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.llm import leaks, packing, quality, quantiles
from teleloom.plans.storage import Workspace
from teleloom.sources.tables import table

QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
GROUP = ["service_name", "name"]


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each partition's summaries merged into one for each group."""
    parts = quantiles.summaries(table(spark, sf_dir, "spans"), GROUP, "duration_ns")
    return quantiles.percentiles(quantiles.merge_summaries(parts, GROUP), GROUP, QUANTILES)


def p1_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of each day of arrival, merged into those of all days."""
    spans = table(spark, sf_dir, "spans").withColumn("day", F.date_format("received_at", "yyyy-MM-dd"))
    days = quantiles.merge_summaries(quantiles.summaries(spans, [*GROUP, "day"], "duration_ns"), [*GROUP, "day"])
    return quantiles.percentiles(quantiles.merge_summaries(days.drop("day"), GROUP), GROUP, QUANTILES)


def p1_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the answers of small buffers, which collapse in most groups, are within their bound; the SQL says all are."""
    spans, k = table(spark, sf_dir, "spans"), 32
    answers = quantiles.percentiles(quantiles.merge_summaries(quantiles.summaries(spans, GROUP, "duration_ns", k, 4), GROUP, k, 4), GROUP, QUANTILES, k, 4)
    answers = Workspace(spark, "answers").put("answers", answers)
    return quantiles.within_bound(spans, GROUP, "duration_ns", answers, QUANTILES)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_sizes"))


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the packs, counted over all of them; the SQL says nothing is."""
    counts = Workspace(spark, "counts").put("tokens", packing.token_counts(table(spark, sf_dir, "documents")))
    sizes = table(spark, sf_dir, "pack_sizes")
    return packing.violations(packing.pack(counts, sizes), counts, sizes)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the unedited passages, found by a plain join, the search finds too: all of them, by the SQL."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leaks.exact_runs(docs, items).join(p9_found(spark, sf_dir), ["doc_id", "item_id"], "left_semi")


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.statistics(docs, quality.fit_profiles(docs, table(spark, sf_dir, "doc_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir).filter(~F.col("is_prose")).select("doc_id").distinct()


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir)


def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_from_days, p1_within, p8_packs, p8_report, p8_violations, p9_found, p9_runs, p9_exact, p10_found, p10_statistics, p10_counts)}

#: Exact ranks; the summaries are exact for groups of fewer than 2048 values, which all groups are at this scale.
_RANKS = """WITH ranked AS (
  SELECT service_name, name, duration_ns, row_number() OVER (PARTITION BY service_name, name ORDER BY duration_ns) AS r,
    count(*) OVER (PARTITION BY service_name, name) AS n
  FROM spans WHERE duration_ns IS NOT NULL)
SELECT service_name, name, CAST(max(n) AS BIGINT) AS n, CAST(0 AS BIGINT) AS rank_error,
  min(duration_ns) FILTER (WHERE r >= 0.5 * n) AS p50, min(duration_ns) FILTER (WHERE r >= 0.9 * n) AS p90,
  min(duration_ns) FILTER (WHERE r >= 0.99 * n) AS p99
FROM ranked GROUP BY service_name, name"""

_COUNTS = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, trim(regexp_replace(t, '[ \t\n\r]+', ' ', 'g')) AS w, regexp_replace(t, '[ \t\n\r]+', '', 'g') AS b FROM t)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars,
  CAST(CASE WHEN w = '' THEN 0 ELSE length(w) - length(replace(w, ' ', '')) + 1 END AS BIGINT) AS n_words,
  CAST(CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END AS BIGINT) AS n_lines,
  CAST(length(b) AS BIGINT) AS n_word_chars FROM s"""

#: Texts with 20 consecutive words of an item as they are, nine triples of which at least fewer than three items have.
_EXACT = """WITH it AS (
  SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
tri AS (
  SELECT item_id, p, array_to_string(list_slice(w, p, p + 2), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS p FROM it) AS x),
n AS (SELECT g, count(DISTINCT item_id) AS n FROM tri GROUP BY g),
own AS (
  SELECT item_id, p, sum(CASE WHEN n < 3 THEN 1 ELSE 0 END)
    OVER (PARTITION BY item_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 17 FOLLOWING) AS k
  FROM tri JOIN n USING (g)),
iw AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + 19), ' ') AS g
  FROM own JOIN it USING (item_id) WHERE k >= 9 AND p + 19 <= len(w)),
dw AS (
  SELECT doc_id, array_to_string(list_slice(w, p, p + 19), ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL) AS d) AS x)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)"""

_NO_VIOLATIONS = """SELECT pack_id, CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS divided
FROM pack_sizes WHERE capacity_tokens > 0"""

_WITHIN = """SELECT service_name, name, CAST(count(*) AS BIGINT) AS n, true AS p50, true AS p90, true AS p99
FROM spans WHERE duration_ns IS NOT NULL GROUP BY service_name, name"""

SQL = {"p1_within": _WITHIN, "p8_violations": _NO_VIOLATIONS, "p9_exact": _EXACT, "p10_counts": _COUNTS, "p1_percentiles": _RANKS, "p1_from_days": _RANKS}
