"""The operators' registered queries: each runs over its whole table with production parameters."""

from __future__ import annotations

from .common import table
from .exact_dedup import exact_dedup
from .hmm import score
from .licenses import license_scan
from .minhash import near_dedup
from .packing import pack
from .pieces import encode
from .quality import quality
from .simhash import near_documents
from .suffix import suffix_dedup
from .toxicity import toxicity

QUERIES = {
    "op1_near_dedup": lambda spark, d: near_dedup(table(spark, d, "documents")),
    "op2_license_scan": lambda spark, d: license_scan(table(spark, d, "documents")),
    "op3_toxicity": lambda spark, d: toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_quality": lambda spark, d: quality(table(spark, d, "documents")),
    "op5_suffix_dedup": lambda spark, d: suffix_dedup(table(spark, d, "documents")),
    "op6_simhash": lambda spark, d: near_documents(table(spark, d, "documents")),
    "op7_exact_dedup": lambda spark, d: exact_dedup(table(spark, d, "documents")),
    "op8_packing": lambda spark, d: pack(table(spark, d, "documents")),
    "op9_lm_score": lambda spark, d: score(table(spark, d, "documents")),
    "op10_sentencepiece": lambda spark, d: encode(table(spark, d, "documents")),
}

ORACLE_SQL = {
    "op7_exact_dedup": """
        SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE unhex(sha256(text)) END AS digest,
               CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER g END AS keep_id,
               CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER g END AS copies,
               text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_kept
        FROM documents WINDOW g AS (PARTITION BY text)""",
}
