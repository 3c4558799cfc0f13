"""Queries and DuckDB oracles of the corpus operators."""

from __future__ import annotations

from . import collocations, decontamination, line_dedup, mixing, ngram_join, packing, pii, quality, secret_scan, sharding, substring_dedup, warc, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_warc": warc.op3_warc,
    "op4_pii": pii.op4_pii,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_sharding": sharding.op10_sharding,
    "op11_collocations": collocations.op11_collocations,
    "op12_whitening": whitening.op12_whitening,
    "op13_packing": packing.op13_packing,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_decontamination": decontamination.ORACLE,
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
        r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM r""",
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op11_collocations": collocations.ORACLE,
}
