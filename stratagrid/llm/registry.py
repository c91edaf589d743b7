"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import linededup, mixing, neighbours, ogg, packing, sharding, simhash, toxicity, warc, wrapper

QUERIES = {
    "op1_nnpu_toxicity": toxicity.op1_nnpu_toxicity,
    "op2_ogg_media": ogg.op2_ogg_media,
    "op3_line_edit_join": linededup.op3_line_edit_join,
    "op4_nnls_packing": packing.op4_nnls_packing,
    "op5_warc_chunks": warc.op5_warc_chunks,
    "op6_simhash_components": simhash.op6_simhash_components,
    "op7_posting_list_search": neighbours.op7_posting_list_search,
    "op8_wrapper_text": wrapper.op8_wrapper_text,
    "op9_jump_hash_shards": sharding.op9_jump_hash_shards,
    "op10_soft_mixing": mixing.op10_soft_mixing,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op5_warc_chunks": warc.ORACLE,
}
