"""The registered queries of the operators: each takes (spark, sf_dir)."""

from __future__ import annotations

from driftspark.llm.chat import op5_query
from driftspark.llm.decontaminate import op4_query
from driftspark.llm.jaccard_join import op6_query
from driftspark.llm.language_id import op12_query
from driftspark.llm.licenses import op2_query
from driftspark.llm.merkle import op13_query
from driftspark.llm.neighbours import op9_query
from driftspark.llm.packing import op1_query
from driftspark.llm.quality import op10_query
from driftspark.llm.sharding import op3_query
from driftspark.llm.substring_dedup import op8_query
from driftspark.llm.url_filter import op7_query
from driftspark.llm.whitening import op11_query

QUERIES = {
    "op1_packing": op1_query,
    "op2_license_scan": op2_query,
    "op3_sharding": op3_query,
    "op4_decontamination": op4_query,
    "op5_chat_formatting": op5_query,
    "op6_jaccard_join": op6_query,
    "op7_url_filter": op7_query,
    "op8_substring_dedup": op8_query,
    "op9_nearest_neighbours": op9_query,
    "op10_quality_classifier": op10_query,
    "op11_embedding_whitening": op11_query,
    "op12_language_id": op12_query,
    "op13_merkle_manifest": op13_query,
}
