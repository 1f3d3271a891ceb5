"""The jobs as registered queries: each runs twice into one new folder and returns what it wrote, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.shared import new_folder

from . import consensus, holdout


def job1_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation split of all documents. See holdout."""
    folder = new_folder(spark, "job1-holdout")
    for _ in range(2):
        path = holdout.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", folder)
    return holdout.rows(spark, path)


def job2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library of consensus peaks of all events. See consensus."""
    folder = new_folder(spark, "job2-consensus")
    for _ in range(2):
        path = consensus.run(spark, f"{sf_dir}/events*.parquet", f"{folder}/output", f"{folder}/checkpoint")
    return consensus.rows(spark, path)


QUERIES = {"job1_holdout": job1_holdout, "job2_consensus": job2_consensus}
ORACLES = {
    "job1_holdout": """
WITH own AS (
    SELECT doc_id, text, coalesce(nullif(lang, ''), 'none') AS lang, source,
           lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS normal, coalesce(source IN ('src4', 'src5', 'src6'), false) AS held
    FROM documents
),
best AS (SELECT doc_id, max(quality)::INT AS quality FROM labels GROUP BY doc_id),
keyed AS (
    SELECT sha256(normal) AS key, own.doc_id AS doc_id, text, lang, source, quality, held
    FROM own LEFT JOIN best ON best.doc_id = own.doc_id WHERE normal <> ''
),
of_key AS (
    SELECT key, count(*) AS n_rows, count(DISTINCT source) AS n_sources, bool_and(held) AS all_held, bool_or(held) AS any_held
    FROM keyed GROUP BY key
),
first AS (
    SELECT * FROM keyed
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY quality DESC NULLS LAST, doc_id NULLS LAST, source NULLS LAST, lang, text) = 1
)
SELECT key, doc_id, text, source, quality, n_rows, n_sources, any_held AND NOT all_held AS leaked,
       CASE WHEN all_held THEN 'held' WHEN ('0x' || key[1:4])::INT % 100 < 5 THEN 'validation' ELSE 'train' END AS split, lang
FROM first JOIN of_key USING (key)""",
    "job2_consensus": """
WITH RECURSIVE every AS (
    SELECT event_id AS seq, user_id AS molecule_id, event_type AS adduct, floor(value * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT AS mz,
           try_cast(json_extract_string(props, '$.k') AS BIGINT) + 1 AS strength
    FROM events
),
p AS (
    SELECT * FROM every WHERE seq IS NOT NULL AND molecule_id IS NOT NULL AND adduct IS NOT NULL AND mz IS NOT NULL AND strength > 0
    QUALIFY row_number() OVER (PARTITION BY seq, molecule_id ORDER BY mz, strength, adduct) = 1
),
o AS (SELECT *, row_number() OVER (PARTITION BY molecule_id, adduct ORDER BY mz, seq) AS i FROM p),
w AS (
    SELECT molecule_id, adduct, i, mz, strength, mz AS anchor FROM o WHERE i = 1
    UNION ALL
    SELECT o.molecule_id, o.adduct, o.i, o.mz, o.strength, CASE WHEN o.mz - w.anchor <= 2000000 THEN w.anchor ELSE o.mz END
    FROM w JOIN o ON o.molecule_id = w.molecule_id AND o.adduct = w.adduct AND o.i = w.i + 1
)
SELECT molecule_id, adduct, anchor AS lowest, max(mz) AS highest, count(*) AS n_peaks, sum(strength)::BIGINT AS strength,
       sum(mz::HUGEINT * strength)::DOUBLE / sum(strength)::DOUBLE / 1e6::DOUBLE AS mz, ((molecule_id % 16 + 16) % 16)::INT AS bucket
FROM w GROUP BY molecule_id, adduct, anchor""",
}
