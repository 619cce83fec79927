"""Operators for training-data corpora. Nothing else in the library imports this subpackage."""

from . import chat_repair, chat_rotation, cube_mixing, itq_neighbors, ngram_trie, paragraph_minhash, phrase_mining, quality_bands, sentencepiece_codec, simhash_anchors, suffix_dedup, url_lists, voronoi_knn

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.query,
    "op2_paragraph_minhash": paragraph_minhash.query,
    "op3_quality_rules": quality_bands.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_url_lists": url_lists.query,
    "op6_simhash": simhash_anchors.query,
    "op7_chat_rotation": chat_rotation.query,
    "op8_itq_neighbors": itq_neighbors.query,
    "op9_ngram_trie": ngram_trie.query,
    "op10_cube_mixing": cube_mixing.query,
    "op11_phrase_mining": phrase_mining.query,
    "op12_voronoi_knn": voronoi_knn.query,
    "op13_chat_repair": chat_repair.query,
}

#: DuckDB SQL for those that SQL can express; the others are tested against brute force.
ORACLES = {
    "op5_url_lists": url_lists.ORACLE,
    "op7_chat_rotation": chat_rotation.ORACLE,
    "op11_phrase_mining": phrase_mining.ORACLE,
    "op12_voronoi_knn": voronoi_knn.ORACLE,
}
