"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from inkspark.llm import decontaminate, embedding_dedup, language_id, lm_score, minhash_dedup, mixing, phrases, secret_scan, sharding, spelling, topk, url_filter, warc

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_language_id": language_id.query,
    "op3_lm_score": lm_score.registered,
    "op4_mixing": mixing.query,
    "op5_minhash_dedup": minhash_dedup.query,
    "op6_sharding": sharding.query,
    "op7_url_filter": url_filter.query,
    "op8_warc": warc.query,
    "op9_secret_scan": secret_scan.query,
    "op10_decontaminate": decontaminate.query,
    "op11_spelling_variants": spelling.query,
    "op12_topk_search": topk.query,
    "op13_phrase_mining": phrases.query,
}
#: the others learn from the data, align texts or deal rows; tests/llm hold them against brute force
ORACLES: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op8_warc": warc.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op12_topk_search": topk.ORACLE,
    "op13_phrase_mining": phrases.ORACLE,
}
