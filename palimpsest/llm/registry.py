"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from palimpsest.llm import decontamination, near_dedup, packing, pii, quality_classifier, quality_rules, sharding, suffix_dedup, url_filters, warc

OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.y FROM r JOIN u ON r.reach = u.x),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


def queries() -> dict:
    """opN_<name> for each operator, and ``pipeline``."""
    return {
        "op1_pii_surrogates": pii.op1_pii_surrogates,
        "op2_warc_normaliser": warc.op2_warc_normaliser,
        "op3_cgk_decontamination": decontamination.op3_cgk_decontamination,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_chosen_path_dedup": near_dedup.op5_chosen_path_dedup,
        "op6_url_filters": url_filters.op6_url_filters,
        "op7_histogram_shards": sharding.op7_histogram_shards,
        "op8_suffix_levels": suffix_dedup.op8_suffix_levels,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    """SQL where it can express the query's rows and columns."""
    return {"op2_warc_normaliser": warc.OP2_SQL, "op5_chosen_path_dedup": OP5_SQL, "op8_suffix_levels": suffix_dedup.OP8_SQL}
