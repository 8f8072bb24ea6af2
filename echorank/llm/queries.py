"""All registered queries of the subpackage."""

from echorank.llm import bpe_queries, contamination_queries, curriculum_queries, dialogue_queries, hmm_queries, lloyd_queries, native_queries, neardup_queries, pii_queries, topk_queries, toxicity_queries, warc_queries  # noqa: F401
from echorank.llm.registry import query

QUERIES, ORACLES = query.queries, query.oracles
