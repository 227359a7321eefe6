"""The jobs as registered queries: two runs into one new folder, then its output; with the SQL for that output."""

from __future__ import annotations

from jobs import period_survey, sequence_register
from strandlace.plans.catalogue import DNA_SQL, NULL_SQL, PG_SQL
from strandlace.session import scratch


def job1(spark, sf_dir: str):
    """The period survey of all documents."""
    out = scratch(spark)
    for _ in range(2):
        period_survey.run(spark, f"{sf_dir}/documents.parquet", out)
    return period_survey.output(spark, out)


def job2(spark, sf_dir: str):
    """The sequence register of all documents; the second run finds nothing new."""
    out = scratch(spark)
    for _ in range(2):
        sequence_register.run(spark, f"{sf_dir}/documents.parquet", out)
    return sequence_register.output(spark, out)


QUERIES = {"job1_period_survey": job1, "job2_sequence_register": job2}

ORACLES = {
    "job1_period_survey": PG_SQL
    + f""", nul AS ({NULL_SQL}),
sc AS (SELECT doc_id, k, CASE WHEN n_pairs > 0 THEN signal_sum / n_pairs ELSE 0 END AS score,
  CASE WHEN n_pairs = 0 OR sqrt(n_pairs * 144.0 * coalesce(variance, 0)) <= 2.220446049250313e-16 THEN 0 ELSE (raw_sum - n_pairs * 12 * mean) / sqrt(n_pairs * 144.0 * variance) END AS z FROM pg LEFT JOIN nul USING (doc_id)),
md AS (SELECT *, lag(score) OVER o AS p, lead(score) OVER o AS n, median(score) OVER (PARTITION BY doc_id) AS med FROM sc WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
th AS (SELECT *, median(abs(score - med)) OVER (PARTITION BY doc_id) AS mad FROM md),
tt AS (SELECT *, CASE WHEN mad <= 0 THEN 5.0 ELSE greatest(5.0, med + mad * (3.0 * 1.4826)) END AS threshold FROM th),
pp AS (SELECT *, coalesce(score > p AND score > n AND score >= threshold, false) AS period FROM tt)
SELECT CAST(pp.doc_id AS VARCHAR) AS record, CAST(1 AS BIGINT) AS n_rows, length({DNA_SQL}) AS length, k, round(score, 6) AS signal_mean, round(z, 6) AS z_score, round(threshold, 6) AS threshold,
  CASE WHEN period THEN CAST(row_number() OVER (PARTITION BY pp.doc_id, period ORDER BY score DESC, k) AS INT) END AS period_rank, lang
FROM pp JOIN documents USING (doc_id)""",
    "job2_sequence_register": PG_SQL
    + """, g AS (SELECT sha256(seq) AS sha, any_value(length(seq)) AS length, count(*) AS n_records, min(doc_id) AS first_id FROM seqs GROUP BY seq)
SELECT sha, CAST(length AS BIGINT) AS length, n_records, first_id, k, raw_sum, signal_sum, CAST(n_pairs AS BIGINT) AS n_pairs FROM g JOIN pg ON pg.doc_id = first_id""",
}
