"""Queries of this subpackage and the SQL that tells their results where SQL can."""

from __future__ import annotations

from tessera.llm.centroids import OP13_SQL, op13_centroid_clustering
from tessera.llm.chat_format import OP9_SQL, op9_chat_formatting
from tessera.llm.fingerprints import op3_fingerprints
from tessera.llm.language_id import op6_language_id
from tessera.llm.language_model import op5_lm_scoring
from tessera.llm.lattice_dedup import op10_embedding_dedup
from tessera.llm.mixing import OP8_SQL, op8_mixing
from tessera.llm.nearest import op12_nearest_neighbours
from tessera.llm.ngram_join import op2_ngram_jaccard_join
from tessera.llm.packing import op4_packing
from tessera.llm.sharding import op1_sharding
from tessera.llm.structure_repair import OP11_SQL, op11_structure_repair
from tessera.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_fingerprints": op3_fingerprints,
    "op4_packing": op4_packing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_structure_repair": op11_structure_repair,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op8_mixing": OP8_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op11_structure_repair": OP11_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
